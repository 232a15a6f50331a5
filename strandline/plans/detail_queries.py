"""Queries over what surrounds results: explanations, listed sources, components, keys, ordered sums and checks of transcribed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import assign, explain, gold, labs, strategy, within
from strandline.plans.registry import query
from strandline.plans.resolution import _AT, _DAYS, DAY, LADDER, NOT_ERRORS, POOL, day_values, timed_values
from strandline.sources.tables import ZONES, measurements, table

NAMES = [g.name for g in POOL]


@query("st19_explanations", _AT + f""", f AS (SELECT owner, d, min(pos) AS sel, min_by(value, pos) AS value FROM v GROUP BY ALL), t AS (SELECT *, {NAMES!r}[CAST(sel AS INTEGER) + 1] AS name FROM f)
SELECT owner, d AS local_date, CASE WHEN owner % 5 = 0 THEN 'The value was set by hand; the rule gives ' || regexp_replace(printf('%.2f', CAST(round(CAST(round(value, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)), '[.]?0+$', '') || '.' WHEN sel = 0 THEN 'The value comes from ' || name || ', the first source of the rule.'
  ELSE 'The value comes from ' || name || ', because ' || array_to_string({NAMES!r}[1:CAST(sel AS INTEGER)], ', ') || ' had no usable data.' END || CASE WHEN d > DATE '2024-01-20' THEN ' The window hasn''t ended yet.' ELSE '' END AS explanation FROM t""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = strategy.first_available(strategy.gates(timed_values(spark, sf_dir)), DAY)
    names = F.array(*[F.lit(n) for n in NAMES])
    none, no = F.lit(None).cast("long"), F.lit(False)
    text = explain.explanation(F.col("status"), F.get(names, F.col("selected")), F.slice(names, F.lit(1), F.col("skipped")), F.lit(1), F.when(F.col("owner") % 5 == 0, "set_value"), F.col("value"), F.col("local_date") > F.lit("2024-01-20").cast("date"), no, none)
    return r.select(*DAY, text.alias("explanation"))


@query("st7_listed_sources", _DAYS + """, w AS (SELECT DISTINCT owner, d FROM v), l AS (SELECT w.owner, w.d, ['view', 'click'][p.pos + 1] AS name, coalesce(CASE WHEN v.value IS NULL THEN 'no_data' END, 'valid') AS status, p.pos AS place FROM w CROSS JOIN (SELECT unnest([0, 1]) AS pos) p LEFT JOIN v ON v.owner = w.owner AND v.d = w.d AND v.pos = p.pos
UNION ALL SELECT DISTINCT m.owner, m.d, source, CASE WHEN source = 'error' THEN 'excluded' ELSE 'not_in_rule' END, CASE WHEN source = 'error' THEN 2 ELSE 3 END FROM m JOIN w ON w.owner = m.owner AND w.d = m.d WHERE source NOT IN ('view', 'click'))
SELECT owner, d AS local_date, string_agg(name || ':' || status, ',' ORDER BY place, name) AS listed FROM l GROUP BY ALL""")
def listed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of the rule in its order, then sources that it excludes, then those outside it."""
    v = day_values(spark, sf_dir)
    days = v.select(*DAY).distinct()
    own = strategy.gates(strategy.spine(days, len(LADDER)).join(v, [*DAY, "pos"], "left"))
    names = F.array(*[F.lit(g.name) for g in LADDER])
    own = own.select(*DAY, F.col("pos").alias("place"), F.get(names, F.col("pos")).alias("name"), strategy.group_status(F.col("reason")).alias("status"))
    m = measurements(spark, sf_dir).withColumn("status", assign.membership(assign.position(LADDER, NOT_ERRORS))).where("status <> 'grouped'").join(days, DAY, "left_semi")
    other = m.select(*DAY, F.when(F.col("status") == "excluded", 2).otherwise(3).alias("place"), F.col("source").alias("name"), "status").distinct()
    both = own.union(other).groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("place", "name", "status"))).alias("l"))
    return both.select(*DAY, F.array_join(F.transform("l", lambda x: F.concat(x["name"], F.lit(":"), x["status"])), ",").alias("listed"))


@query("ag6_reading_means", """, o AS (SELECT owner, d, s // 7200000000 AS reading, source, max_by(value, (s, id)) AS value FROM m GROUP BY ALL) SELECT owner, d AS local_date, source AS code, round(avg(value), 6) AS value, count(*) AS readings FROM o GROUP BY ALL""")
def reading_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the day's readings for each component."""
    m = measurements(spark, sf_dir).withColumn("reading", within.bucket_of("start_at", 7_200_000_000))
    one = within.latest(m, [*DAY, "reading", "source"])
    return within.mean_of_readings(one, DAY, "reading", "source").select(*DAY, F.col("source").alias("code"), F.round("value", 6).alias("value"), "readings")


@query("ag27_component_rollup", """, v AS (SELECT owner, d, source AS code, avg(value) AS value, count(*) AS n, d >= DATE '2024-01-25' AS partial FROM m GROUP BY ALL), y AS (SELECT owner, code, unnest(range(30)) AS i FROM (SELECT DISTINCT owner, code FROM v))
SELECT y.owner, y.code, count(v.value) AS n, count(*) AS days, round(avg(v.value), 8) AS mean, round(min(v.value), 8) AS min, round(max(v.value), 8) AS max FROM y LEFT JOIN v ON v.owner = y.owner AND v.code = y.code AND v.d = DATE '2024-01-01' + CAST(i AS INTEGER) AND NOT partial GROUP BY y.owner, y.code""")
def component_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup by component; days that haven't ended and days without a value don't count."""
    m = measurements(spark, sf_dir)
    values = m.groupBy("owner", "local_date", F.col("source").alias("code")).agg(F.avg("value").alias("value")).where("local_date < date '2024-01-25'")
    days = m.select("owner", F.col("source").alias("code")).distinct().withColumn("local_date", F.explode(F.expr("sequence(date '2024-01-01', date '2024-01-30')")))
    return gold.rollup(values, days, ["owner", "code"], False).select("owner", "code", "n", "days", *[F.round(c, 8).alias(c) for c in ("mean", "min", "max")])


@query("ag24_four_record_kinds", """SELECT 'interval' AS kind, count(*) AS n, min(s) AS first_at, max(s) AS last_at, count(DISTINCT d) AS days, max_by(id, (s, id)) AS newest FROM m WHERE e > s UNION ALL SELECT 'instant', count(*), min(s), max(s), count(DISTINCT d), max_by(id, (s, id)) FROM m WHERE e = s
UNION ALL SELECT 'order', count(*), min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)), count(DISTINCT CAST(o_orderdate AS DATE)), max_by(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) FROM orders UNION ALL SELECT 'line', count(*), min(epoch_us(l_shipdate)), max(epoch_us(l_shipdate)), count(DISTINCT CAST(l_shipdate AS DATE)), max_by(l_orderkey, (epoch_us(l_shipdate), l_orderkey)) FROM lineitem""")
def four_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("id", F.unix_micros("start_at").alias("at"), F.col("local_date").alias("day"), (F.col("end_at") > F.col("start_at")).alias("lasts"))
    of = lambda t, i, at: table(spark, sf_dir, t).select(F.col(i).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.to_date(at).alias("day"))
    return gold.inventory({"interval": m.where("lasts"), "instant": m.where("not lasts"), "order": of("orders", "o_orderkey", "o_orderdate"), "line": of("lineitem", "l_orderkey", "l_shipdate")})


@query("wn10_keys_of_kinds", f""", x AS (SELECT id, s, d, ['local_day', 'local_night', 'hour', 'bucket', 'latest', 'reading', 'sleep_episode'][1 + id % 7] AS kind FROM m)
SELECT id, CASE WHEN kind IN ('local_day', 'local_night') THEN strftime(d, '%Y-%m-%d') WHEN kind = 'reading' THEN 'm:' || CAST(id AS VARCHAR) WHEN kind = 'latest' THEN strftime(make_timestamp((s + 60000000) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(s // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS key FROM x""")
def keys_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("local_day", "local_night", "hour", "bucket", "latest", "reading", "sleep_episode")]), (F.col("id") % 7 + 1).cast("int"))
    return m.select("id", scalars.key_of(kind, F.col("start_at"), F.col("local_date"), F.expr("start_at + interval 1 minute"), F.concat(F.lit("m:"), F.col("id").cast("string"))).alias("key"))


@query("so3_ordered_sums", """, o AS (SELECT owner, source, s // 21600000000 AS b, list(value ORDER BY s, id) AS vs FROM m GROUP BY ALL) SELECT owner, source, b, list_reduce(list_prepend(0.0::DOUBLE, vs), lambda a, x: a + x) AS total FROM o""")
def ordered_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in the order of time, so that they are the same to the last bit wherever they run."""
    m = measurements(spark, sf_dir)
    return gold.ordered_sum(m, ["owner", "source", within.bucket_of("start_at", 21_600_000_000).alias("b")], "value", ["start_at", "id"])


@query("fp10_exists_flags", """SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS rich, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS supplies FROM nation""", events=False)
def exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("rich", F.lit(True))
    supplies = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("supplies", F.lit(True))
    return n.join(rich, "n_nationkey", "left").join(supplies, "n_nationkey", "left").select("n_nationkey", F.coalesce("rich", F.lit(False)).alias("rich"), F.coalesce("supplies", F.lit(False)).alias("supplies"))


@query("fp13_source_identities", """SELECT c_custkey, n_name || '/' || r_name || '/' || CASE WHEN c_acctbal < 0 THEN 'manual' ELSE 'device' END AS identity FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""", events=False)
def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    source = F.struct(F.col("n_name").alias("provider"), F.col("r_name").alias("origin"), (F.col("c_acctbal") < 0).alias("manual"))
    got = joined.select("c_custkey", source.alias("source"))
    return got.select("c_custkey", F.concat_ws("/", "source.provider", "source.origin", F.when(F.col("source.manual"), "manual").otherwise("device")).alias("identity"))


@query("fp14_shown_values", """SELECT l_orderkey, l_linenumber, round(l_quantity / 8 - 3, 2) AS value, round(l_discount / 3, 3) AS coverage FROM lineitem""", events=False)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.rounded(F.col("l_quantity") / 8 - 3, 2).alias("value"), scalars.rounded(F.col("l_discount") / 3, 3).alias("coverage"))


@query("st9_workout_source", _AT + """, c AS (SELECT owner, d, min_by(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, (s, id)) AS wg FROM m WHERE source = 'error' GROUP BY ALL), o AS (SELECT v.*, CASE WHEN pos = wg THEN -1 ELSE pos END AS place FROM v LEFT JOIN c USING (owner, d))
SELECT owner, d AS local_date, round(min_by(value, place), 6) AS value, CAST(min_by(pos, place) AS INTEGER) AS selected FROM o GROUP BY ALL""")
def workout_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a workout the group that recorded it stands first; membership never changes."""
    m = measurements(spark, sf_dir).where("source = 'error'")
    found = m.groupBy(*DAY).agg(F.min_by(F.when(F.col("k") % 2 == 0, 2).otherwise(1), F.struct("start_at", "id")).alias("recorded"))
    v = strategy.recorded_first(timed_values(spark, sf_dir), found, DAY)
    return v.groupBy(*DAY).agg(F.round(F.min_by("value", "ladder"), 6).alias("value"), F.min_by("pos", "ladder").alias("selected"))


@query("lb3_transcription_warnings", """, r AS (SELECT id, id % 15 AS f, CASE WHEN id % 15 <> 14 THEN source || CAST(id AS VARCHAR) END AS analyte FROM m)
SELECT id, CASE f WHEN 0 THEN 'value_mismatch' WHEN 1 THEN 'comparator_mismatch' WHEN 2 THEN 'range_mismatch' WHEN 3 THEN 'evidence_unverified' WHEN 4 THEN 'value_not_in_evidence' WHEN 5 THEN 'unknown_unit' WHEN 6 THEN 'unit_not_convertible' WHEN 7 THEN 'unit_missing' WHEN 8 THEN 'date_missing'
  WHEN 9 THEN 'date_in_future' WHEN 10 THEN 'date_ambiguous' WHEN 11 THEN 'reported_before_collected' WHEN 13 THEN 'already_confirmed' WHEN 14 THEN 'unknown_analyte' ELSE '' END AS warnings FROM r""")
def transcription_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one fault each, by id."""
    f, day = F.col("id") % 15, lambda d: F.lit(d).cast("date")
    rows = measurements(spark, sf_dir).select(
        "id", F.when(f != 14, F.concat("source", F.col("id").cast("string"))).alias("analyte"), F.when(f == 0, 9.9).otherwise(1.5).alias("value"), F.lit("< 1,5").alias("value_text"), F.when(f == 1, ">").otherwise("<").alias("comparator"), F.when(f == 2, 3.0).otherwise(1.0).alias("low"), F.lit(2.5).alias("high"),
        F.lit("1,0 – 2.5").alias("range_text"), F.when(f == 3, "made up < 1.5").when(f == 4, "Glucose").otherwise("Glucose <1.5").alias("evidence"), F.lit("Page. Glucose  < 1,5 mmol/L 1,0 – 2.5").alias("page_text"), F.when(f == 5, "unknown").when(f == 6, "refused").when(f == 7, None).otherwise("canonical").alias("unit_state"),
        F.when(f == 8, None).when(f == 9, day("2031-01-01")).otherwise(day("2024-01-15")).alias("collected"), F.when(f == 11, day("2024-01-10")).when(f == 9, day("2031-01-02")).otherwise(day("2024-01-16")).alias("reported"), F.when(f == 10, "03/04/2024").otherwise("15.01.2024").alias("date_text"), F.lit(False).alias("rejected"),
    )
    confirmed = rows.where("id % 15 = 13").select("analyte", "collected")
    got = labs.transcription_warnings(rows, confirmed, F.lit("2024-02-01").cast("date"))
    return got.select("id", F.array_join("warnings", ",").alias("warnings"))


@query("lb_ranges", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 END AS low, CASE p_partkey % 4 WHEN 0 THEN p_size + 1.5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS high, CASE WHEN p_size % 14 BETWEEN 1 AND 12 AND p_size % 13 BETWEEN 1 AND 12 AND p_size % 14 <> p_size % 13 THEN true ELSE false END AS ambiguous FROM part""", events=False)
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(i == 0, F.concat(n, F.lit(" - "), n.cast("int").cast("string"), F.lit(",0"))).otherwise("")
    text = F.when(i == 0, F.concat(n, F.lit(" - "), (F.col("p_size") + 1).cast("string"), F.lit(",5"))).when(i == 1, F.concat(F.lit("< "), n)).when(i == 2, F.concat(F.lit(">"), n, F.lit(",5"))).otherwise("negative")
    low, high = scalars.range_of(text)
    date = F.concat_ws("/", (F.col("p_size") % 14).cast("string"), (F.col("p_size") % 13).cast("string"), F.lit("2024"))
    return p.select("p_partkey", low.alias("low"), high.alias("high"), scalars.ambiguous_date(date).alias("ambiguous"))


@query("ag1_classes_together", """, k AS (SELECT id, owner, d, source, s, e, value, CASE source WHEN 'view' THEN 'intensive' WHEN 'purchase' THEN 'additive' WHEN 'error' THEN 'additive' WHEN 'click' THEN 'daily_summary' ELSE 'latest' END AS agg, CASE WHEN k >= 80 THEN 'daily_value' WHEN e > s AND source IN ('purchase', 'error') THEN 'interval' ELSE 'sample' END AS kind FROM m),
i AS (SELECT owner, d, source, avg(v) AS value, 'bucket_means' AS basis FROM (SELECT owner, d, source, s // 300000000 AS b, avg(value) AS v FROM k WHERE agg = 'intensive' AND kind <> 'daily_value' GROUP BY ALL) GROUP BY owner, d, source),
ad AS (SELECT owner, d, source, max_by(value, (s, id)) AS value FROM k WHERE agg = 'additive' AND kind = 'daily_value' GROUP BY ALL), ai AS (SELECT owner, d, source, sum(value) AS value FROM k WHERE agg = 'additive' AND kind <> 'daily_value' GROUP BY ALL),
a AS (SELECT coalesce(ad.owner, ai.owner) AS owner, coalesce(ad.d, ai.d) AS d, coalesce(ad.source, ai.source) AS source, coalesce(ad.value, ai.value) AS value, CASE WHEN ad.value IS NOT NULL THEN 'daily_value' ELSE 'intervals' END AS basis FROM ad FULL JOIN ai ON ad.owner = ai.owner AND ad.d = ai.d AND ad.source = ai.source),
s AS (SELECT owner, d, source, max_by(value, (kind = 'daily_value', s, id)) AS value, CASE WHEN bool_or(kind = 'daily_value') THEN 'daily_value' ELSE 'latest' END AS basis FROM k WHERE agg = 'daily_summary' GROUP BY ALL), l AS (SELECT owner, d, source, max_by(value, (s, id)) AS value, 'latest' AS basis FROM k WHERE agg = 'latest' GROUP BY ALL)
SELECT owner, d AS local_date, source AS metric, round(value, 4) AS value, basis FROM (SELECT * FROM i UNION ALL SELECT * FROM a UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l)""")
def classes_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all classes in one table, each aggregated as its class asks."""
    m = measurements(spark, sf_dir)
    agg = F.when(F.col("source") == "view", "intensive").when(F.col("source").isin("purchase", "error"), "additive").when(F.col("source") == "click", "daily_summary").otherwise("latest")
    kind = F.when(F.col("k") >= 80, "daily_value").when((F.col("end_at") > F.col("start_at")) & F.col("source").isin("purchase", "error"), "interval").otherwise("sample")
    rows = m.select("id", *DAY, F.col("source").alias("metric"), F.lit("one").alias("source"), "start_at", F.when(kind == "interval", F.col("end_at")).otherwise(F.col("start_at")).alias("end_at"), "value", agg.alias("agg"), kind.alias("kind"))
    return within.aggregate(rows, [*DAY, "metric"]).withColumn("value", F.round("value", 4))
