"""Queries over exports, imports and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import exchange, joins
from strandline.plans.gold_queries import _HOURLY
from strandline.plans.registry import query
from strandline.sources.scratch import Scratch
from strandline.sources.tables import SQL, measurements, table
from strandline.streaming import marks

ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("sc10_sc20_export", "SELECT 'orders' AS name, count(*) AS rows, true AS intact FROM orders UNION ALL SELECT 'nation', count(*), true FROM nation", events=False)
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as JSON lines with a manifest, read again by their schemas and held against it."""
    folder = Scratch(spark, "export").root
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").cast("string").alias("n_name"))
    exchange.export({"orders": _orders(spark, sf_dir), "nation": nation}, folder)
    return exchange.verified(spark, folder, {"orders": ORDERS, "nation": "n_nationkey bigint, n_name string"})


@query("sc12_se3_import", """WITH x AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx, o_totalprice FROM orders) SELECT k AS key, round(o_totalprice, 2) AS value, nx AS next_key FROM x WHERE k % 3 <> 0""", events=False)
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import skips the third that is there, gives new rows ids of their own and points their chains at ids of this store."""
    from pyspark.sql import Window

    folder = Scratch(spark, "import").root
    o = _orders(spark, sf_dir)
    nx = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    exchange.export({"chain": o.select((F.col("o_orderkey") + 7).alias("id"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_totalprice").alias("value"), (nx + 7).alias("superseded_by"))}, folder)
    incoming = exchange.load_intact(spark, folder, "chain", "id bigint, key string, value double, superseded_by bigint")
    stored = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderkey").alias("id"))
    new, ids = exchange.import_new(incoming, stored, "key", ["superseded_by"])
    names = incoming.select(F.col("id").alias("old_id"), "key").join(ids, "old_id").select("id", F.col("key").alias("_n"))
    number = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)")
    return new.join(names.select(F.col("id").alias("superseded_by"), "_n"), "superseded_by", "left").select(number("key").alias("key"), F.round("value", 2).alias("value"), number("_n").alias("next_key"))


@query("sc11_csv_export", """SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""", events=False)
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the names of what they refer to as CSV, read back as they were."""
    folder = Scratch(spark, "csv").root
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    exchange.export_csv(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "n_name"), folder)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double, n_name string").csv(folder, header=True, escape='"')


@query("sc13_batch_files", """SELECT s_nationkey AS nation, count(*) AS items, sum(s_suppkey) AS keys FROM supplier GROUP BY ALL""", events=False)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a folder, some lines long each, and what they hold."""
    folder = Scratch(spark, "batches").root
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("long")).alias("items"))
    s.repartition(8, "s_nationkey").select(F.to_json(F.struct(F.col("s_nationkey").cast("long").alias("nation"), "items"))).write.text(folder)
    got = spark.read.schema("nation bigint, items array<bigint>").json(folder)
    return got.select("nation", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("sc14_sc15_xml_import", """, x AS (SELECT id, s // 1000000 AS t, value, owner FROM m WHERE source = 'view') SELECT CAST(owner AS VARCHAR) AS source, t AS start, value, id % 3 = 0 AS known FROM x""")
def xml_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone's XML export read by its records; those that the store has already, to the second, are told apart."""
    folder = Scratch(spark, "xml").root
    m = measurements(spark, sf_dir).where("source = 'view'")
    at = F.date_format("start_at", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.lit('<Record type="HR" sourceName="'), F.col("owner").cast("string"), F.lit('" unit="bpm" value="'), F.col("value").cast("string"), F.lit('" startDate="'), at, F.lit(' +0000" endDate="'), at, F.lit(' +0000"/>'))
    # files of some hundred records, each a document of its own
    page = m.groupBy(F.expr("id div 2000").alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("all"))
    page.select("part", F.concat(F.lit("<HealthData>\n"), F.col("all"), F.lit("\n</HealthData>"))).write.partitionBy("part").text(folder)
    got = exchange.read_health_xml(spark, folder).withColumn("value", F.col("value").cast("double")).withColumn("s", F.unix_micros("start")).withColumn("e", F.unix_micros("end")).withColumn("ord", F.xxhash64("source", "s", "value"))
    stored = m.where("id % 3 = 0").select(F.col("owner").cast("string").alias("source"), F.unix_micros("start_at").alias("s"), F.unix_micros("start_at").alias("e"), "value")
    met = joins.fuzzy(got.select("ord", "source", "s", "e", "value"), stored, ["source"]).select("ord").withColumn("known", F.lit(True))
    return got.join(met, "ord", "left").select("source", F.unix_seconds("start").alias("start"), "value", F.coalesce("known", F.lit(False)).alias("known"))


def _rows(m: DataFrame, seq: int) -> DataFrame:
    return m.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "owner", "source", "zone", "start_at", "end_at", "value", F.lit(False).alias("deleted"), F.lit(seq).cast("long").alias("seq"))


def _interval() -> F.Column:
    return F.col("source").isin("purchase", "error")


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows before, and a batch with late rows, corrections of values and of times, deletions, repeats and rows that are older than what is stored."""
    m = measurements(spark, sf_dir)
    before = marks.merged(spark.createDataFrame([], marks.ROW + ", local_date date"), _rows(m.where("id % 7 <> 3"), 1))[0]
    late, fixed = _rows(m.where("id % 7 = 3"), 2), _rows(m.where("id % 50 = 1 and id % 7 <> 3"), 2).withColumn("value", F.col("value") + 1)
    moved = _rows(m.where("id % 50 = 2 and id % 7 <> 3"), 2).withColumn("start_at", F.expr("start_at + interval 2 days")).withColumn("end_at", F.expr("end_at + interval 2 days"))
    gone = _rows(m.where("id % 50 = 4 and id % 7 <> 3"), 2).withColumn("deleted", F.lit(True))
    same, old = _rows(m.where("id % 50 = 5 and id % 7 <> 3"), 2), _rows(m.where("id % 50 = 6 and id % 7 <> 3"), 0).withColumn("value", F.lit(-1.0))
    return before, late.union(fixed).union(moved).union(gone).union(same).union(old)


# the same rows after all, as the measurements that the hourly statement goes on from
_AFTER = SQL.replace("m AS (", "m0 AS (", 1).replace("FROM events)", "FROM events)") + """, m AS (SELECT id, owner, source, k, zone, flags, CASE WHEN id % 50 = 1 AND id % 7 <> 3 THEN value + 1 ELSE value END AS value,
  CASE WHEN id % 50 = 2 AND id % 7 <> 3 THEN s + 172800000000 ELSE s END AS s, CASE WHEN id % 50 = 2 AND id % 7 <> 3 THEN e + 172800000000 ELSE e END AS e, d FROM m0 WHERE NOT (id % 50 = 4 AND id % 7 <> 3))"""
_HOURS_AFTER = "WITH RECURSIVE " + _AFTER + _HOURLY + " SELECT owner, source, local_date, hour_start, samples, buckets, round(bucket_mean_sum, 4) AS bucket_mean_sum, min_value, max_value, round(interval_sum, 4) AS interval_sum FROM h"


@query("sr3_sr7_marked_rebuild", _HOURS_AFTER, events=False)
def marked_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours after a batch of late, corrected and deleted rows, marked days built again only: equal to building everything."""
    from strandline.operators import gold

    scratch = Scratch(spark, "rebuild")
    before, batch = _states(spark, sf_dir)
    before = scratch.save(before)
    hours = scratch.save(gold.hourly(before, ["owner", "source"], _interval()))
    after, touched = marks.merged(before, batch)
    got = marks.rebuilt(hours, scratch.save(after), scratch.save(touched), _interval())
    return got.select("owner", "source", "local_date", "hour_start", "samples", "buckets", F.round("bucket_mean_sum", 4).alias("bucket_mean_sum"), "min_value", "max_value", F.round("interval_sum", 4).alias("interval_sum"))


@query("sr3_marks", """, c AS (SELECT * FROM m WHERE id % 7 = 3 OR id % 50 IN (1, 2, 4)), o AS (SELECT owner, source, d FROM c UNION SELECT owner, source, CAST((make_timestamp(s + 172800000000) AT TIME ZONE 'UTC') AT TIME ZONE zone AS DATE) FROM c WHERE id % 50 = 2 AND id % 7 <> 3) SELECT owner, source, d AS local_date FROM o""")
def touched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, batch = _states(spark, sf_dir)
    return marks.merged(before, batch)[1]


_RULES = (("rest", ["heart"], None, None, "local_night"), ("steps", ["steps"], None, "heart", "local_day"), ("energy", ["energy"], ["steps"], None, "local_day"), ("weight", ["weight"], None, None, "latest"))


def _reaches(spark: SparkSession) -> DataFrame:
    return marks.reach(spark.createDataFrame(list(_RULES), "metric string, codes array<string>, leader_codes array<string>, wear string, kind string"))


@query("sr5_reach", """WITH r AS (SELECT p_partkey AS k, 'm' || CAST(p_partkey AS VARCHAR) AS metric, ['local_day', 'local_night', 'latest', 'sleep_episode', 'hour'][1 + p_partkey % 5] AS kind FROM part),
d AS (SELECT metric, k, kind, unnest(list_distinct(list_filter([metric, 'c' || CAST(k % 7 AS VARCHAR), 'c' || CAST(k % 3 AS VARCHAR), CASE WHEN k % 4 = 0 THEN 'c' || CAST(k % 5 AS VARCHAR) END, CASE WHEN k % 6 = 0 THEN 'pulse' END, CASE WHEN kind IN ('local_night', 'sleep_episode') THEN 'sleep' END], lambda x: x IS NOT NULL))) AS dep FROM r)
SELECT metric, dep, CASE WHEN kind = 'latest' THEN 366 WHEN k % 6 = 0 THEN 30 ELSE 3 END AS before, 2 AS after FROM d""", events=False)
def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules of parts read: their codes, their leaders', wear and sleep, and how many days around a date."""
    k = F.col("p_partkey")
    code = lambda n: F.concat(F.lit("c"), (k % n).cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("local_day", "local_night", "latest", "sleep_episode", "hour")]), (k % 5 + 1).cast("int"))
    rules = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("metric"), F.array(code(7), code(3)).alias("codes"), F.when(k % 4 == 0, F.array(code(5))).alias("leader_codes"), F.when(k % 6 == 0, "pulse").alias("wear"), kind.alias("kind"))
    return marks.reach(rules)


@query("sr4_sr6_invalidated", """, c AS (SELECT DISTINCT owner, d, unnest(['rest', 'steps', 'energy']) AS metric FROM m), k AS (SELECT DISTINCT owner, d FROM m WHERE id % 40 = 0)
SELECT owner, d AS local_date, metric FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.owner = c.owner AND ((metric = 'rest' AND c.d BETWEEN k.d - 2 AND k.d + 3) OR (metric = 'steps' AND c.d BETWEEN k.d - 2 AND k.d + 30))) AND NOT (metric = 'energy' AND owner % 2 = 0)""")
def invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept results after heart rate was marked on some days and a rule was replaced; results of the old rule go."""
    m = measurements(spark, sf_dir)
    ref = F.when((F.col("metric") == "energy") & (F.col("owner") % 2 == 0), "energy:1").otherwise(F.concat("metric", F.lit(":2")))
    cache = m.select("owner", "local_date").distinct().withColumn("metric", F.explode(F.array(*[F.lit(x) for x in ("rest", "steps", "energy")]))).withColumn("kind", F.lit("local_day")).withColumn("rule_ref", ref)
    marked = m.where("id % 40 = 0").select("owner", F.lit("heart").alias("dep"), "local_date").distinct()
    active = spark.createDataFrame([("rest", "rest:2"), ("steps", "steps:2"), ("energy", "energy:2")], "metric string, rule_ref string")
    return marks.invalidated(cache, marked, _reaches(spark), active).select("owner", "local_date", "metric")


@query("sr4_cacheable", """, w AS (SELECT DISTINCT owner, d, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE zone) AS e FROM m) SELECT owner, d AS local_date FROM w WHERE e <= 1705320000000000 AND (owner, d) NOT IN (SELECT (owner, d) FROM m WHERE id % 40 = 0)""")
def cacheable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.operators.windows import day_bounds

    m = measurements(spark, sf_dir)
    days = day_bounds(m.select("owner", "local_date", "zone").distinct()).withColumn("window_end", F.unix_micros("day_end"))
    return marks.cacheable(days, m.where("id % 40 = 0"), F.lit(1_705_320_000_000_000)).select("owner", "local_date")


@query("sr1_due_units", """, c AS (SELECT source AS stream, max(s) AS high FROM m WHERE s < 1706000000000000 GROUP BY ALL), u AS (SELECT stream, unnest(range((high - 172800000000) // 86400000000, (1706200000000000 - 1) // 86400000000 + 1)) AS u FROM c)
SELECT stream, u * 86400000000 AS lo, least((u + 1) * 86400000000, 1706200000000000) AS hi FROM u""")
def due_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to fetch for each stream: two back from its high mark, for corrections, up to now."""
    m = measurements(spark, sf_dir).withColumn("s", F.unix_micros("start_at")).where("s < 1706000000000000")
    cursors = m.groupBy(F.col("source").alias("stream")).agg(F.max("s").alias("high"))
    return marks.due_units(cursors, F.lit(1_706_200_000_000_000), 172_800_000_000, 86_400_000_000)
