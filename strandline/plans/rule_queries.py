"""Rule documents made of the tables' rows: checked, set against one another, and resolved."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import rules, strategy, within
from strandline.operators.windows import ALLOWED
from strandline.plans.registry import query
from strandline.plans.resolution import _DAYS, DAY
from strandline.sources import catalogue
from strandline.sources.tables import measurements, table

# What the documents of parts are made of: every part picks by its key and size, so that most of them have several faults.
METRICS, KINDS, OPS = ("pulse", "clicks", "level", "total", "nothing"), ("bucket", "hour", "local_day", "local_night", "latest", "week"), ("first_available", "single_source", "mean_across_sources", "sum_across_sources", "best")
_AGG = {m[0]: m[1] for m in catalogue.METRICS}
_ALLOWED = " OR ".join(f"(metric = '{m}' AND kind IN ({', '.join(repr(k) for k in ALLOWED[_AGG[m]])}))" for m in METRICS[:4])

_FAULTS = f"""WITH d AS (SELECT p_partkey AS k, {list(METRICS)!r}[1 + p_partkey % 5] AS metric, {list(KINDS)!r}[1 + p_size % 6] AS kind, CASE p_size % 7 WHEN 0 THEN '5m' WHEN 1 THEN '7m' END AS size, {list(OPS)!r}[1 + p_partkey // 5 % 5] AS op,
  CASE p_partkey % 13 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS least FROM part),
e AS (SELECT k, list_filter([
  CASE WHEN k % 17 = 0 THEN '/extra' END, CASE WHEN metric = 'nothing' THEN '/metric' END, CASE WHEN kind = 'week' OR (metric <> 'nothing' AND NOT ({_ALLOWED})) THEN '/window/kind' END,
  CASE WHEN CASE WHEN kind = 'bucket' THEN coalesce(size <> '5m', true) ELSE size IS NOT NULL END THEN '/window/size' END,
  CASE WHEN op = 'best' OR (metric <> 'nothing' AND ((op = 'mean_across_sources' AND metric = 'total') OR (op = 'sum_across_sources' AND metric <> 'clicks'))) THEN '/strategy/op' END,
  CASE WHEN op = 'single_source' THEN '/groups' END, CASE WHEN least IS NOT NULL AND (NOT ends_with(op, '_across_sources') OR least > 2) THEN '/strategy/min_sources' END, CASE WHEN op = 'sum_across_sources' THEN '/acknowledged_warnings' END,
  CASE WHEN k % 11 IN (0, 1) THEN '/groups/1/id' END, CASE WHEN k % 19 = 0 THEN '/groups/1/match/0/entry' END], lambda x: x IS NOT NULL) AS p FROM d)
SELECT k AS id, array_to_string(list_sort(list_distinct(p)), ',') AS pointers FROM e"""


def _pick(items: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items) + 1).cast("int"))


@query("st16_st4_checked_rules", _FAULTS, events=False)
def checked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part, and the places of its faults: unknown fields and names, windows and strategies that the metric can't have."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    op = _pick(OPS, F.expr("p_partkey div 5"))
    group = lambda i, **m: F.struct(i.alias("id"), F.array(F.create_map(*[x for f, v in m.items() for x in (F.lit(f), v)])).alias("match"))
    groups = F.array(group(F.lit("a"), provider=F.concat(F.lit("p"), k.cast("string"))), group(F.when(k % 11 == 0, "a").when(k % 11 == 1, "B!").otherwise("b"), entry=F.when(k % 19 == 0, "robot").otherwise("manual")))
    doc = F.to_json(F.struct(
        F.lit(rules.VERSION).alias("schema"), _pick(METRICS, k).alias("metric"), F.struct(_pick(KINDS, F.col("p_size")).alias("kind"), F.when(F.col("p_size") % 7 == 0, "5m").when(F.col("p_size") % 7 == 1, "7m").alias("size")).alias("window"), groups.alias("groups"),
        F.struct(op.alias("op"), F.when(k % 13 == 0, 3).when(k % 13 == 1, 2).alias("min_sources")).alias("strategy"), F.when(k % 17 == 0, "?").alias("extra"),
    ))
    found = F.array_join(F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["pointer"]))), ",")
    return rules.checked(p.select(k.alias("id"), doc.alias("doc")), catalogue.metrics(spark)).select("id", found.alias("pointers"))


@query("st17_ladders", "SELECT n_nationkey AS rule, CAST(count(*) AS INTEGER) AS groups, CASE WHEN count(*) > 32 THEN '/groups' ELSE '' END AS pointers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL", events=False)
def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder for each nation, its suppliers being the groups, made into documents and checked."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    rows = s.select(
        F.col("n_nationkey").alias("rule"), F.col("n_nationkey").alias("owner"), F.lit("pulse").alias("metric"), F.lit("local_day").alias("window"), F.lit("first_available").alias("op"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("s"), key).alias("group"),
        F.array(F.create_map(F.lit("provider"), F.concat(F.lit("s"), key)), F.create_map(F.lit("origin_name"), F.col("s_name"), F.lit("entry"), F.lit("device"))).alias("match"),
    )
    docs = catalogue.documents(rows).withColumnRenamed("rule", "id")
    got = rules.checked(docs, catalogue.metrics(spark)).withColumn("r", F.from_json("doc", rules.RULE))
    return got.select(F.col("id").alias("rule"), F.size("r.groups").alias("groups"), F.array_join(F.transform("errors", lambda e: e["pointer"]), ",").alias("pointers"))


@query("st17_default_rules", """WITH c AS (SELECT p_partkey AS k, ['intensive', 'additive', 'latest', 'daily_summary', 'sleep_derived'][1 + p_partkey % 5] AS agg FROM part)
SELECT 'm' || CAST(k AS VARCHAR) AS metric, CASE WHEN agg <> 'sleep_derived' AND k % 10 <> 9 THEN 'local_day' ELSE 'local_night' END AS "window", CASE WHEN k % 6 = 0 THEN 1 ELSE 4 END AS groups FROM c WHERE k % 3 <> 0 OR k % 6 = 0""", events=False)
def default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for parts as metrics that have none of their own."""
    k = F.col("p_partkey")
    code = F.concat(F.lit("m"), k.cast("string"))
    agg = _pick(("intensive", "additive", "latest", "daily_summary", "sleep_derived"), k)
    known = table(spark, sf_dir, "part").select(code.alias("code"), agg.alias("agg"), F.lit(None).cast("string").alias("reading"), (k % 6 == 0).alias("provider_scoped"), F.lit(False).alias("selection_only"), F.when(k % 10 == 9, F.concat(F.lit("m"), (k - 1).cast("string"))).alias("derived_from"))
    ruled = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 and p_partkey % 6 <> 0").select(code.alias("metric"))
    return rules.defaults(known, ruled, ["shop", "phone"]).select("metric", "window", F.size("groups").alias("groups"))


_SET = """, r AS (SELECT p_partkey AS id, 'm' || CAST(CASE WHEN p_partkey % 40 = 5 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS metric,
  'm' || CAST(CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 2 WHEN p_partkey % 50 = 9 THEN p_partkey - 2 WHEN p_partkey % 4 = 2 THEN p_partkey // 2 END AS VARCHAR) AS follow, p_partkey % 3 AS w FROM part),
after_ AS (SELECT * FROM r), before_ AS (SELECT * FROM r WHERE id % 5 <> 0 AND id % 9 <> 0)"""


def _problems(s: str) -> str:
    return f""", reach_{s}(metric, leader) AS (SELECT metric, follow FROM {s} WHERE follow IS NOT NULL UNION SELECT q.metric, {s}.follow FROM reach_{s} q JOIN {s} ON q.leader = {s}.metric WHERE {s}.follow IS NOT NULL),
p_{s} AS (SELECT id, 'duplicate_metric' AS problem FROM {s} QUALIFY row_number() OVER (PARTITION BY metric ORDER BY id) > 1 UNION SELECT a.id, 'other_window' FROM {s} a JOIN {s} b ON a.follow = b.metric WHERE a.w <> b.w
  UNION SELECT {s}.id, 'follow_cycle' FROM {s} JOIN reach_{s} q ON q.metric = {s}.metric AND q.leader = q.metric)"""


@query("st18_activation_problems", "WITH RECURSIVE x AS (SELECT 1)" + _SET + _problems("after_") + _problems("before_") + " SELECT * FROM p_after_ EXCEPT SELECT * FROM p_before_", events=False)
def activation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules of parts would break that come into force beside the others: a metric twice, other windows than the leader's, cycles."""
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("m"), n.cast("string"))
    follow = F.when(k % 50 == 7, name(k + 2)).when(k % 50 == 9, name(k - 2)).when(k % 4 == 2, name(F.expr("p_partkey div 2")))
    after = table(spark, sf_dir, "part").select(k.alias("id"), name(F.when(k % 40 == 5, k - 1).otherwise(k)).alias("metric"), follow.alias("follow"), F.struct((k % 3).cast("string").alias("kind"), F.lit(None).cast("string").alias("size")).alias("window"))
    return rules.activation_diff(after.where("id % 5 <> 0 and id % 9 <> 0"), after)


def _base(**more) -> dict:
    return {"schema": rules.VERSION, "metric": "pulse", "window": {"kind": "local_day"}, "groups": [{"id": "a", "match": [{"provider": "p"}]}, {"id": "b", "match": [{"entry": "manual"}]}], "strategy": {"op": "first_available"}} | more


# Rules of the stand-in metric by owner: two orders and a pool, as documents in a table.
_OWN = [json.dumps(_base(groups=[{"id": g, "match": [{"origin_key": g}]} for g in order], strategy={"op": op})) for order, op in ((("view", "click"), "first_available"), (("click", "view"), "first_available"), (("view", "click"), "mean_across_sources"))]


@query("st16_resolved_by_rules", _DAYS.replace("b AS (SELECT owner, d, pos, source,", "b AS (SELECT owner, d, source, ").replace("AS b, avg(value)", "AS b, any_value(pos) AS pos, avg(value)").replace("GROUP BY ALL),\nc AS", "GROUP BY owner, d, source, s // 300000000),\nc AS") + """
SELECT owner, d AS local_date, round(CASE owner % 3 WHEN 0 THEN min_by(value, pos) WHEN 1 THEN max_by(value, pos) ELSE avg(value) END, 6) AS value, CASE owner % 3 WHEN 0 THEN ['view', 'click'][CAST(min(pos) AS INTEGER) + 1] WHEN 1 THEN ['view', 'click'][CAST(max(pos) AS INTEGER) + 1] END AS selected FROM v GROUP BY owner, d""")
def resolved_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days resolved by each owner's own rule document: groups come from the parsed documents, by a join."""
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(_OWN)], "rule int, doc string")
    r = rules.parsed(docs).select("rule", F.col("r.strategy.op").alias("op"), F.posexplode("r.groups").alias("pos", "g")).select("rule", "op", "pos", F.col("g.id").alias("group"), F.explode("g.match").alias("match"))
    r = r.select("rule", "op", "pos", "group", F.col("match")["origin_key"].alias("source"))
    m = measurements(spark, sf_dir).withColumn("rule", (F.col("owner") % 3).cast("int")).join(r, ["rule", "source"])
    v = strategy.gates(within.intensive(m, [*DAY, "op", "pos", "group"]))
    picked = v.groupBy(*DAY, "op").agg(F.min_by(F.struct("value", "group"), "pos").alias("first"), F.avg("value").alias("mean"))
    pool = F.col("op") == "mean_across_sources"
    return picked.select(*DAY, F.round(F.when(pool, F.col("mean")).otherwise(F.col("first.value")), 6).alias("value"), F.when(~pool, F.col("first.group")).alias("selected"))
