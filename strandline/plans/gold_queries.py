"""Queries over aggregates: hours, series, coverage, inventories, rollups, trends and the star-schema joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import gold, joins, windows
from strandline.plans.registry import query
from strandline.sources.tables import ZONES, measurements, table, zone_of

# Local hours from the wall clock: every hour of every local day of a zone, then rows joined on them by range.
LOCAL_HOURS = f""", days AS (SELECT z, CAST(g AS DATE) AS d FROM (SELECT unnest({list(ZONES)!r}) AS z), generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) t(g)),
bounds AS (SELECT z, d, epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE z) AS d0, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE z) AS d1 FROM days),
lh AS (SELECT z, d, hs, least(hs + 3600000000, d1) AS he FROM (SELECT z, d, d1, unnest(range(d0, d1, 3600000000)) AS hs FROM bounds))"""
_HOURLY = LOCAL_HOURS + """, k1 AS (SELECT *, source IN ('purchase', 'error') AND e > s AS lasts FROM m),
p AS (SELECT k1.owner, k1.source, k1.id, k1.s, k1.e, k1.value, k1.lasts, lh.d AS local_date, lh.hs, CASE WHEN lasts THEN greatest(s, hs) ELSE s END AS lo, CASE WHEN lasts THEN least(e, he) ELSE s END AS hi
  FROM k1 JOIN lh ON lh.z = k1.zone AND CASE WHEN lasts THEN s < he AND e > hs ELSE s >= hs AND s < he END),
means AS (SELECT owner, source, hs, sum(mean) AS bms FROM (SELECT owner, source, hs, s // 300000000, avg(value) AS mean FROM p WHERE NOT lasts GROUP BY ALL) GROUP BY ALL),
touched AS (SELECT owner, source, hs, count(DISTINCT b) AS buckets FROM (SELECT owner, source, hs, unnest(CASE WHEN lasts THEN range(lo // 300000000, (hi - 1) // 300000000 + 1) ELSE [lo // 300000000] END) AS b FROM p) GROUP BY ALL),
h AS (SELECT owner, source, local_date, hs AS hour_start, count(*) AS samples, any_value(buckets) AS buckets, coalesce(any_value(bms), 0) AS bucket_mean_sum, min(value) AS min_value, max(value) AS max_value,
    coalesce(sum(CASE WHEN lasts THEN value * (hi - lo) / (e - s) END), 0) AS interval_sum, min(lo) AS first_at, max(hi) AS last_at
  FROM p JOIN touched USING (owner, source, hs) LEFT JOIN means USING (owner, source, hs) GROUP BY owner, source, local_date, hs)"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.hourly(measurements(spark, sf_dir), ["owner", "source"], F.col("source").isin("purchase", "error"))


@query("ag18_hourly_rebuild", _HOURLY + """
SELECT owner, source, local_date, hour_start, samples, buckets, round(bucket_mean_sum, 4) AS bucket_mean_sum, min_value, max_value, round(interval_sum, 4) AS interval_sum, first_at, last_at FROM h""")
def hourly_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("bucket_mean_sum", "interval_sum")})


@query("ag19_source_series", _HOURLY + """
SELECT owner, source, local_date, min(hour_start) AS hour_start, round(sum(bucket_mean_sum) / sum(buckets), 4) AS mean, min(min_value) AS min, max(max_value) AS max, round(sum(interval_sum), 3) AS sum, CAST(sum(samples) AS BIGINT) AS samples FROM h GROUP BY owner, source, local_date""")
def source_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = gold.series(hours(spark, sf_dir), ["owner", "source", "local_date"])
    return by_day.withColumn("mean", F.round("mean", 4)).withColumn("sum", F.round("sum", 3))


@query("ag20_median_spacing", """, g AS (SELECT owner, d, s - lag(s) OVER (PARTITION BY owner, d ORDER BY s, id) AS gap FROM m),
r AS (SELECT owner, d, gap, row_number() OVER (PARTITION BY owner, d ORDER BY gap) AS i, count(*) OVER (PARTITION BY owner, d) AS n FROM g WHERE gap IS NOT NULL)
SELECT owner, d AS local_date, gap AS spacing FROM r WHERE i = n // 2 + 1""")
def median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.spacing(measurements(spark, sf_dir), ["owner", "local_date"])


GRIDS = (300, 900, 1800)  # seconds; the operator takes any


@query("ag20_intraday_minutes", f""", g AS (SELECT unnest({list(GRIDS)}) * 1000000 AS size), w AS (SELECT *, source IN ('purchase', 'error') AND e > s AS lasts FROM m),
b AS (SELECT owner, source, size, s // size AS slot, avg(value) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM w, g WHERE NOT lasts GROUP BY ALL),
x AS (SELECT owner, source, size, s, e, value, unnest(range(s // size, (e - 1) // size + 1)) AS slot FROM w, g WHERE lasts),
y AS (SELECT owner, source, size, slot, sum(value * (least(e, (slot + 1) * size) - greatest(s, slot * size)) / (e - s)) AS total FROM x GROUP BY ALL)
SELECT coalesce(b.owner, y.owner) AS owner, coalesce(b.source, y.source) AS source, CAST(coalesce(b.size, y.size) // 1000000 AS INTEGER) AS seconds, coalesce(b.slot, y.slot) AS slot, round(mean, 6) AS mean, min, max, coalesce(n, 0) AS n, round(total + 0.0000001, 3) AS total
FROM b FULL JOIN y ON b.owner = y.owner AND b.source = y.source AND b.size = y.size AND b.slot = y.slot""")
def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of every source at all grids: means of samples, sums of intervals by their share."""
    m = measurements(spark, sf_dir)
    parts = [gold.intraday(m, ["owner", "source"], F.col("source").isin("purchase", "error"), g * 1_000_000).withColumn("seconds", F.lit(g)) for g in GRIDS]
    return reduce(DataFrame.union, parts).select("owner", "source", "seconds", "slot", F.round("mean", 6).alias("mean"), "min", "max", "n", F.round(F.col("total") + 0.0000001, 3).alias("total"))


@query("ag21_coverage", _HOURLY + """
SELECT owner, source, local_date, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lh WHERE lh.d = h.local_date AND lh.z = any_value(m2.zone)), 6) AS coverage FROM h JOIN (SELECT DISTINCT owner, zone FROM m) m2 USING (owner) GROUP BY owner, source, local_date""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the hours of a local day (23, 24 or 25) in which a source has data."""
    held = hours(spark, sf_dir).groupBy("owner", "source", "local_date").agg(F.count("*").alias("n")).withColumn("zone", zone_of(F.col("owner")))
    span = F.ceil((F.unix_seconds("day_end") - F.unix_seconds("day_start")) / 3600)
    return windows.day_bounds(held).select("owner", "source", "local_date", F.round(F.col("n") / span, 6).alias("coverage"))


@query("ag22_inventory_bounds", """
SELECT source, min(s) AS first_at, max(s) AS last_at, max_by(value, (s, id)) AS latest, min_by(value, (s, id)) AS earliest FROM m GROUP BY ALL""")
def inventory_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("start_at", "id")
    return measurements(spark, sf_dir).groupBy("source").agg(F.min(F.unix_micros("start_at")).alias("first_at"), F.max(F.unix_micros("start_at")).alias("last_at"), F.max_by("value", order).alias("latest"), F.min_by("value", order).alias("earliest"))


@query("ag23_inventory_counts", """
SELECT source, count(*) AS n, count(DISTINCT (owner, d)) AS days, count(DISTINCT owner) AS owners FROM m GROUP BY ALL""")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # days first, so that one pass with partial aggregates does instead of an expansion for two distinct counts
    per_day = measurements(spark, sf_dir).groupBy("source", "owner", "local_date").agg(F.count("*").alias("n"))
    per_owner = per_day.groupBy("source", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("days"))
    return per_owner.groupBy("source").agg(F.sum("n").alias("n"), F.sum("days").alias("days"), F.count("*").alias("owners"))


@query("ag24_inventory_records", """
SELECT 'interval' AS kind, count(*) AS n, min(s) AS first_at, max(s) AS last_at, count(DISTINCT d) AS days FROM m WHERE e > s UNION ALL
SELECT 'instant', count(*), min(s), max(s), count(DISTINCT d) FROM m WHERE e = s UNION ALL SELECT 'order', count(*), min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)), count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders""")
def inventory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    one = lambda df, kind, at, day: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.countDistinct(day).alias("days"))
    at = F.unix_micros("start_at")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("t"))
    return one(m.where("end_at > start_at"), "interval", at, "local_date").unionByName(one(m.where("end_at = start_at"), "instant", at, "local_date")).unionByName(one(orders, "order", F.unix_micros("t"), F.to_date("t")))


@query("ag27_rollup", """, v AS (SELECT owner, d, avg(value) AS value FROM m WHERE source = 'view' GROUP BY ALL), o AS (SELECT DISTINCT owner FROM m),
y AS (SELECT owner, unnest(range(30)) AS i FROM o), z AS (SELECT owner, DATE '2024-01-01' + CAST(i AS INTEGER) AS d FROM y)
SELECT z.owner, count(v.value) AS n, count(*) AS days, round(count(v.value) / CAST(count(*) AS DOUBLE), 8) AS coverage, round(avg(v.value), 8) AS mean, round(min(v.value), 8) AS min, round(max(v.value), 8) AS max, round(sum(v.value), 8) AS sum
FROM z LEFT JOIN v ON v.owner = z.owner AND v.d = z.d GROUP BY z.owner""")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    values = m.where("source = 'view'").groupBy("owner", "local_date").agg(F.avg("value").alias("value"))
    days = m.select("owner").distinct().withColumn("local_date", F.explode(F.expr("sequence(date '2024-01-01', date '2024-01-30')")))
    return gold.rollup(values, days, ["owner"], True).select("owner", "n", "days", *[F.round(c, 8).alias(c) for c in ("coverage", "mean", "min", "max", "sum")])


PERIODS = (7, 30, 90, 365)  # days, fixed values


@query("ag28_periods", "WITH v AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS value FROM orders GROUP BY ALL), a AS (SELECT owner, value, DATE '1998-08-02' - d AS age FROM v) SELECT owner, " + ", ".join(
    f"round(avg(value) FILTER (age >= 0 AND age < {n}), 4) AS mean_{n}, round(avg(value) FILTER (age >= {n} AND age < {2 * n}), 4) AS before_{n}, count(*) FILTER (age >= 0 AND age < {n}) AS days_{n}" for n in PERIODS
) + ", coalesce(string_agg(CAST(age AS VARCHAR), ',' ORDER BY age DESC) FILTER (age >= 0 AND age < 30), '') AS spark FROM a GROUP BY owner", events=False)
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved daily values of the last days against as many before them, and the last thirty days as a small series."""
    orders = table(spark, sf_dir, "orders")
    values = orders.groupBy(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("local_date")).agg(F.sum("o_totalprice").alias("value"))
    out = gold.compare_periods(values, ["owner"], F.to_date(F.lit("1998-08-02")), PERIODS, 30)
    line = F.array_join(F.transform("series", lambda x: F.datediff(F.to_date(F.lit("1998-08-02")), x["local_date"]).cast("string")), ",")
    return out.select("owner", *[F.round(c, 4).alias(c) if c[0] in "mb" else c for c in out.columns if c not in ("owner", "series")], line.alias("spark"))


def _trend(unit: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS bucket, count(*) AS n, round(avg(o_totalprice), 8) AS mean, round(sum(o_totalprice), 2) AS sum, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY ALL"""


def _orders_by(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    return gold.trend(orders, [], "day", unit).withColumn("mean", F.round("mean", 8)).withColumn("sum", F.round("sum", 2))


@query("ag29_weekly_trend", _trend("week"), events=False)
def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by(spark, sf_dir, "week")


@query("ag29_monthly_trend", _trend("month"), events=False)
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by(spark, sf_dir, "month")


@query("ag30_provenance", """
SELECT owner, d AS local_date, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT k) AS payloads, max(flags) AS flags FROM m GROUP BY ALL""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).groupBy("owner", "local_date").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("k").alias("payloads"), F.max("flags").alias("flags"))


@query("ag31_all_sources", """, b AS (SELECT owner, d, source, s // 300000000 AS b, avg(value) AS v FROM m GROUP BY ALL)
SELECT owner, d AS local_date, source, round(avg(v), 6) AS value, count(*) AS buckets FROM b GROUP BY ALL""")
def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.operators.within import buckets

    m = measurements(spark, sf_dir)
    keys = ["owner", "local_date", "source"]
    named = m.withColumn("own", F.col("source"))
    return buckets(named, ["owner", "local_date", "own"]).groupBy("owner", "local_date", F.col("own").alias("source")).agg(F.round(F.avg("m"), 6).alias("value"), F.count("*").alias("buckets")).select(*keys, "value", "buckets")


@query("ag35_quantiles", """
SELECT source, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS n_high FROM m GROUP BY ALL""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    q = gold.quantiles(m, ["source"], "value", {"median": 0.5, "p90": 0.9}, 0.5)
    return m.groupBy("source").agg(F.count_if(F.col("value") >= 50).alias("n_high")).join(q, "source").select("source", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "n_high")


@query("ag35_decimated_series", """, c AS (SELECT owner, source, value, s, id, CAST((s - 1704067200000000) // 86400000000 AS BIGINT) AS col FROM m)
SELECT owner, source, col, min(value) AS low, max(value) AS high, min_by(value, (s, id)) AS first, max_by(value, (s, id)) AS last FROM c GROUP BY ALL""")
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series thinned to one column a day for a chart: extremes and ends of each column stay."""
    return gold.decimate(measurements(spark, sf_dir), ["owner", "source"], 1_704_067_200_000_000, 86_400_000_000)


@query("jn1_jn2_dimension_joins", """
SELECT n_name, r_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""", events=False)
def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders shrink to customers before they meet any dimension; Spark broadcasts the small ones by their size
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.groupBy("n_name", "r_name", "o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("jn3_semi", """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""", events=False)
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("jn4_anti", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)""", events=False)
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 350000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("jn6_top_one", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1""", events=False)
def top_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.top_one(orders, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("jn7_overlap", """
SELECT a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM m a JOIN m b ON a.owner = b.owner AND a.source = 'purchase' AND b.source = 'error' AND a.s < b.e AND b.s < a.e AND a.e > a.s AND b.e > b.s""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("id", "owner", "source", F.unix_micros("start_at").alias("s"), F.unix_micros("end_at").alias("e"))
    a = m.where("source = 'purchase'").select("owner", F.col("id").alias("a"), F.col("s").alias("a_lo"), F.col("e").alias("a_hi"))
    b = m.where("source = 'error'").select("owner", F.col("id").alias("b"), F.col("s").alias("b_lo"), F.col("e").alias("b_hi"))
    both = joins.overlap(a, b, ["owner"], ("a_lo", "a_hi"), ("b_lo", "b_hi"))
    return both.select("a", "b", (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).alias("shared"))


@query("jn8_points_in_spans", """
SELECT p.id AS point, w.id AS span FROM m p JOIN m w ON p.owner = w.owner AND p.source = 'view' AND w.source = 'purchase' AND p.s >= w.s AND p.s < w.e""")
def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("id", "owner", "source", F.unix_micros("start_at").alias("s"), F.unix_micros("end_at").alias("e"))
    points = m.where("source = 'view'").select("owner", F.col("id").alias("point"), F.col("s").alias("t"))
    held = m.where("source = 'purchase'").select("owner", F.col("id").alias("span"), F.col("s").alias("lo"), F.col("e").alias("hi"))
    return joins.points_in_spans(points, held, ["owner"], "t", ("lo", "hi")).select("point", "span")


@query("jn9_fuzzy_join", """, a AS (SELECT id, owner, source, s + (id % 5) * 300000 AS s, e + (id % 7) * 250000 AS e, value * (1 + (id % 3) * 0.00007) AS value FROM m)
SELECT DISTINCT a.id FROM a JOIN m ON a.owner = m.owner AND a.source = m.source AND abs(a.s - m.s) < 1000000 AND abs(a.e - m.e) < 1000000 AND abs(a.value - m.value) <= 0.0001 * greatest(abs(a.value), 0.000001)""")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("id", "owner", "source", F.unix_micros("start_at").alias("s"), F.unix_micros("end_at").alias("e"), "value")
    a = m.withColumn("s", F.col("s") + (F.col("id") % 5) * 300_000).withColumn("e", F.col("e") + (F.col("id") % 7) * 250_000).withColumn("value", F.col("value") * (1 + (F.col("id") % 3) * 0.00007))
    return joins.fuzzy(a, m, ["owner", "source"]).select("id")


@query("jn13_null_safe", """, a AS (SELECT source, CASE WHEN k < 90 THEN k END AS k FROM m), x AS (SELECT source, k, count(*) AS n FROM a WHERE source = 'view' GROUP BY ALL), y AS (SELECT source, k, count(*) AS n FROM a WHERE source = 'click' GROUP BY ALL)
SELECT x.k, x.n AS views, y.n AS clicks FROM x JOIN y ON x.k IS NOT DISTINCT FROM y.k""")
def null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("k", F.when(F.col("k") < 90, F.col("k")))
    x = m.where("source = 'view'").groupBy("k").agg(F.count("*").alias("views"))
    y = m.where("source = 'click'").groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("clicks"))
    return x.join(y, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")


@query("jn15_like", """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1' OR p_name LIKE 'Part#%7%' OR p_name LIKE '%a_e%'""", events=False)
def like(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("%1",), ("Part#%7%",), ("%a_e%",), ("",)], "pattern string")
    return joins.any_like(table(spark, sf_dir, "part").select("p_partkey", "p_name"), patterns, "p_name", "pattern")


@query("se1_se2_se3_sets", """SELECT 'union' AS kind, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL
SELECT 'all', count(*) FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)""", events=False)
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    both = s.select("k").union(c)
    return n(both.distinct(), "union").union(n(both, "all")).union(n(c.join(s.where("s_suppkey % 5 = 0"), "k", "left_anti"), "without"))


@query("so2_null_order", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY place LIMIT 50""", events=False)
def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    price = F.when(F.col("o_totalprice") <= 400_000, F.col("o_totalprice"))
    top = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("p")).orderBy(F.col("p").asc_nulls_last(), "o_orderkey").limit(50)  # a report of fifty
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), "o_orderkey"))).select("o_orderkey", "place")


@query("tpch_q1_pricing", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""", events=False)
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
