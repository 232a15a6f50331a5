"""Queries over results that are kept and what makes them go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import strategy, windows
from strandline.plans.registry import query
from strandline.plans.resolution import _POS3, POOL, grouped, zones_of_owners
from strandline.sources.scratch import Scratch
from strandline.sources.tables import measurements
from strandline.streaming import results
from strandline.streaming.results import ResultCache, merged_ranges

RESULT = "window_key string, value double, selected int, status string, window_end long"
DAY = ["owner", "local_date"]
NOW = 1_706_400_000_000_000


def _first(rows: DataFrame) -> DataFrame:
    """The first available group of every day, by plain means."""
    v = grouped(rows, POOL).groupBy(*DAY, "pos").agg(F.avg("value").alias("value"))
    return strategy.first_available(strategy.gates(v), DAY)


def _resolver(rows: DataFrame):  # noqa: ANN202
    def resolve(missed: DataFrame) -> DataFrame:
        got = _first(rows.join(missed.select(*DAY).distinct(), DAY, "left_semi"))
        end = F.unix_micros(F.date_add("local_date", 2).cast("timestamp"))
        return missed.join(got, DAY).withColumn("window_key", F.col("local_date").cast("string")).withColumn("window_end", end)

    return resolve


def _wanted(rows: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    days = rows.select(*DAY).distinct().select(*DAY, F.lit("pulse").alias("metric"), F.lit("local_day").alias("kind"), F.lit("pulse:1").alias("rule_ref"))
    if fixed is None:
        return days.withColumn("fp", F.lit(""))
    return days.join(results.fingerprints(fixed, ["value"]), ["owner", "metric", "local_date"], "left").withColumn("fp", F.coalesce("fp", F.lit("")))


@query("sr4_st15_cached_days", f""", c AS (SELECT owner, d, {_POS3} AS pos, CASE WHEN id % 50 = 7 THEN value + 100 ELSE value END AS value FROM m WHERE id % 50 <> 9 AND {_POS3} IS NOT NULL), v AS (SELECT owner, d, pos, avg(value) AS value FROM c GROUP BY ALL)
SELECT owner, d AS local_date, round(min_by(value, pos), 6) AS value, CAST(min(pos) AS INTEGER) AS selected, CASE WHEN min(pos) = 0 THEN 'direct' ELSE 'fallback' END AS status FROM v GROUP BY ALL""")
def cached_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days read from a cache that was filled before some rows came, changed and went; what the changes reach is resolved again, the rest is as it was kept."""
    m = measurements(spark, sf_dir)
    cache = ResultCache(spark, Scratch(spark, "results").root + "/kept", RESULT, owners=1)
    before, after = m.where("id % 50 <> 8"), m.where("id % 50 <> 9").withColumn("value", F.when(F.col("id") % 50 == 7, F.col("value") + 100).otherwise(F.col("value")))
    cache.read(_wanted(before), _resolver(before), NOW)
    touched = m.where("id % 50 in (7, 8, 9)").select("owner", F.lit("pulse").alias("dep"), "local_date").distinct()
    reaches = spark.createDataFrame([("pulse", "pulse", 0, 0)], "metric string, dep string, before int, after int")
    cache.invalidate(merged_ranges(results.of_marks(touched, reaches)))
    got = cache.read(_wanted(after), _resolver(after), NOW)
    return got.select(*DAY, F.round("value", 6).alias("value"), "selected", "status")


_RANGES = """, q(metric) AS (VALUES ('clicks'), ('pulse')), lo_ AS (SELECT DATE '0001-01-01' AS lo, DATE '9999-12-31' AS hi),
x1 AS (SELECT DISTINCT owner, 'pulse' AS metric, d - 2 AS lo, d + 3 AS hi FROM m WHERE id % 97 = 0),
x2 AS (SELECT DISTINCT owner, 'clicks' AS metric, lo, hi FROM m, lo_ WHERE owner % 7 = 0),
w AS (SELECT * FROM m WHERE source = 'purchase' AND k >= 60 AND id % 10 = 0), x3 AS (SELECT owner, 'pulse' AS metric, d - 1 AS lo, CAST(CAST(make_timestamp(e) AS DATE) + 1 AS DATE) AS hi FROM w),
x4 AS (SELECT DISTINCT owner, metric, DATE '2024-01-09' AS lo, hi FROM m, q, lo_ WHERE owner % 3 = 0),
s AS (SELECT owner, source || ':' || CAST(id % 2 AS VARCHAR) AS device, CASE WHEN id % 3 = 0 THEN 'pulse' ELSE 'clicks' END AS metric, d FROM m),
x5 AS (SELECT owner, metric, min(d) AS lo, max(d) AS hi FROM s WHERE owner % 5 = 0 AND device LIKE 'view:%' GROUP BY owner, device, metric), x6 AS (SELECT owner, metric, min(d) AS lo, max(d) AS hi FROM s WHERE owner % 11 = 0 AND device = 'click:1' GROUP BY owner, metric),
al AS (SELECT * FROM x1 UNION SELECT * FROM x2 UNION SELECT * FROM x3 UNION SELECT * FROM x4 UNION SELECT * FROM x5 UNION SELECT * FROM x6),
f AS (SELECT *, max(hi) OVER (PARTITION BY owner, metric ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM al),
r AS (SELECT *, sum(CASE WHEN far IS NULL THEN 1 WHEN far = DATE '9999-12-31' THEN 0 WHEN lo > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner, metric ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT owner, metric, CAST(min(lo) AS DATE) AS lo, CAST(max(hi) AS DATE) AS hi FROM r GROUP BY owner, metric, run"""


@query("sr6_six_triggers", _RANGES)
def six_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges that late rows, other rules, workouts, zones, devices and origins make stale, merged for each owner and metric."""
    m = measurements(spark, sf_dir)
    owners = m.select("owner").distinct()
    names = spark.createDataFrame([("pulse",), ("clicks",)], "metric string")
    marks = results.of_marks(m.where("id % 97 = 0").select("owner", F.lit("heart").alias("dep"), "local_date"), spark.createDataFrame([("pulse", "heart", 3, 2)], "metric string, dep string, before int, after int"))
    ref = owners.select("owner", F.lit("clicks").alias("metric"), F.lit("clicks:1").alias("rule_ref"))
    rules = results.of_rules(ref, ref.withColumn("rule_ref", F.when(F.col("owner") % 7 == 0, "clicks:2").otherwise(F.col("rule_ref"))))
    w = m.where("source = 'purchase' and k >= 60").select("owner", "id", "k", F.col("local_date").alias("first_date"), F.to_date("end_at").alias("last_date"))
    workouts = results.of_workouts(w, w.withColumn("k", F.when(F.col("id") % 10 == 0, F.lit(-1).cast("long")).otherwise(F.col("k"))), names.where("metric = 'pulse'"))
    old = zones_of_owners(m).where("valid_from < '2024-01-05'")
    new = old.union(zones_of_owners(m).where("owner % 3 = 0 and valid_from > '2024-01-05'"))
    zones = results.of_zones(windows.changed_range(old, new, ["owner"]), names)
    seen = m.select("owner", F.concat("source", F.lit(":"), (F.col("id") % 2).cast("string")).alias("device"), F.when(F.col("id") % 3 == 0, "pulse").otherwise("clicks").alias("metric"), "local_date")
    made = seen.select("owner", "device").distinct().withColumn("model", F.lit("one"))
    devices = results.of_sources(made, made.withColumn("model", F.when((F.col("owner") % 5 == 0) & F.col("device").like("view:%"), "two").otherwise("one")), seen, "device")
    origins = results.of_sources(made, made.withColumn("model", F.when((F.col("owner") % 11 == 0) & (F.col("device") == "click:1"), "other").otherwise("one")), seen, "device")
    all_ = marks
    for more in (rules, workouts, zones, devices, origins):
        all_ = all_.unionByName(more)
    return merged_ranges(all_)
