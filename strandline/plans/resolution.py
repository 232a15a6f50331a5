"""Resolution queries: from many sources to one value for each owner and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import assign, episodes, strategy, windows, within
from strandline.plans.gold_queries import LOCAL_HOURS
from strandline.plans.registry import query
from strandline.sources.scratch import Scratch
from strandline.sources.tables import ZONES, measurements, zone_of

DAY = ["owner", "local_date"]
GROUPED = [*DAY, "pos"]
# Fixed values of the stand-in rules: two groups for resolution, three for pools.
LADDER = (assign.Group("view", (assign.Selector(source="view"),)), assign.Group("click", (assign.Selector(source="click"),)))
POOL = (assign.Group("pages", (assign.Selector(source="view"), assign.Selector(source="click"))), assign.Group("shop", (assign.Selector(source="purchase"),)), assign.Group("new", (assign.Selector(source="signup"),)))
NOT_ERRORS = (assign.Selector(source="error"),)
_POS2 = "CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 1 END"
_POS3 = "CASE WHEN source IN ('view', 'click') THEN 0 WHEN source = 'purchase' THEN 1 WHEN source = 'signup' THEN 2 END"


def grouped(df: DataFrame, groups: tuple = LADDER) -> DataFrame:
    pos = assign.position(groups, NOT_ERRORS)
    return df.withColumn("pos", pos).where("pos >= 0")


def _r(c: str):
    return F.round(c, 6).alias(c)


def day_values(spark: SparkSession, sf_dir: str, groups: tuple = LADDER) -> DataFrame:
    """``(owner, local_date, pos, value, buckets, ...)`` of every group with rows, by equal weights of buckets."""
    return within.intensive(grouped(measurements(spark, sf_dir), groups), GROUPED)


_DAYS = f""", g AS (SELECT *, {_POS2} AS pos FROM m WHERE {_POS2} IS NOT NULL),
b AS (SELECT owner, d, pos, source, s // 300000000 AS b, avg(value) AS mean, count(*) AS n, min(value) AS lo, max(value) AS hi FROM g GROUP BY ALL),
c AS (SELECT owner, d, pos, b, avg(mean) AS m, sum(n) AS n, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY ALL),
v AS (SELECT owner, d, pos, avg(m) AS value, count(*) AS buckets, sum(n) AS n, min(lo) AS lo, max(hi) AS hi FROM c GROUP BY ALL)"""
_DAYS3 = _DAYS.replace(_POS2, _POS3)


@query("st1_first_available_day", _DAYS + """
SELECT owner, d AS local_date, round(min_by(value, pos), 6) AS value, CAST(min(pos) AS INTEGER) AS selected, CASE WHEN min(pos) = 0 THEN 'direct' ELSE 'fallback' END AS status
FROM v GROUP BY owner, d""")
def first_available_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = strategy.gates(day_values(spark, sf_dir))
    return strategy.first_available(values, DAY).select(*DAY, _r("value"), "selected", "status")


@query("st7_every_group_listed", _DAYS + """, w AS (SELECT DISTINCT owner, d FROM v), s AS (SELECT owner, d, unnest([0, 1]) AS pos FROM w)
SELECT s.owner, s.d AS local_date, CAST(s.pos AS INTEGER) AS pos, round(v.value, 6) AS value, CASE WHEN v.value IS NULL THEN 'no_data' END AS reason
FROM s LEFT JOIN v ON s.owner = v.owner AND s.d = v.d AND s.pos = v.pos""")
def every_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = day_values(spark, sf_dir)
    listed = strategy.spine(values.select(*DAY).distinct(), len(LADDER)).join(values, GROUPED, "left")
    return strategy.gates(listed).select(*GROUPED, _r("value"), "reason")


@query("fp3_membership", """
SELECT source, CASE WHEN source = 'error' THEN 'excluded' WHEN source IN ('view', 'click') THEN 'grouped' ELSE 'not_in_rule' END AS membership, count(*) AS n FROM m GROUP BY ALL""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("membership", assign.membership(assign.position(LADDER, NOT_ERRORS)))
    return m.groupBy("source", "membership").agg(F.count("*").alias("n"))


@query("fp5_fp6_row_gates", """
SELECT CASE WHEN flags & 3 <> 0 THEN 'flagged' WHEN value NOT BETWEEN 1.0 AND 150.0 THEN 'implausible' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY ALL""")
def row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(assign.row_gate(3, 1.0, 150.0), F.lit("kept"))
    return measurements(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("fp7_family_gate", """, r AS (SELECT *, s // 3600000000 AS reading FROM m)
SELECT owner, reading, count(*) AS n FROM r GROUP BY ALL HAVING NOT bool_or(flags & 1 <> 0)""")
def family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("reading", within.bucket_of("start_at", 3_600_000_000))
    return assign.family_gate(m, ["owner", "reading"], assign.row_gate(1)).groupBy("owner", "reading").agg(F.count("*").alias("n"))


@query("ag2_intensive_day", _DAYS3 + """
SELECT owner, d AS local_date, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value, buckets, CAST(n AS BIGINT) AS count, lo AS min, hi AS max FROM v""")
def intensive_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_values(spark, sf_dir, POOL).select(*GROUPED, _r("value"), "buckets", "count", "min", "max")


_PARTS = f""", g AS (SELECT *, {_POS3} AS pos FROM m WHERE {_POS3} IS NOT NULL),
x AS (SELECT *, unnest(range(s // 300000000, CASE WHEN e > s THEN (e - 1) // 300000000 ELSE s // 300000000 END + 1)) AS b FROM g),
p AS (SELECT owner, d, pos, source, b, sum(CASE WHEN e > s THEN value * (least(e, (b + 1) * 300000000) - greatest(s, b * 300000000)) / (e - s) ELSE value END) AS v FROM x GROUP BY ALL),
q AS (SELECT owner, d, pos, b, max(v) AS v FROM p GROUP BY ALL),
a AS (SELECT owner, d, pos, sum(v) AS value, count(*) AS buckets FROM q GROUP BY ALL)"""


@query("ag3_additive_day", _PARTS + """
SELECT owner, d AS local_date, CAST(pos AS INTEGER) AS pos, round(value, 4) AS value, buckets FROM a""")
def additive_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within.additive(grouped(measurements(spark, sf_dir), POOL), GROUPED).select(*GROUPED, F.round("value", 4).alias("value"), "buckets")


@query("ag4_daily_or_intervals", _PARTS + f""", r AS (SELECT owner, d, {_POS3} AS pos, source, max_by(value, (s, id)) AS v FROM m WHERE id % 3 = 0 AND {_POS3} IS NOT NULL GROUP BY ALL),
t AS (SELECT owner, d, pos, max(v) AS v FROM r GROUP BY ALL)
SELECT coalesce(t.owner, a.owner) AS owner, coalesce(t.d, a.d) AS local_date, CAST(coalesce(t.pos, a.pos) AS INTEGER) AS pos, round(coalesce(t.v, a.value), 4) AS value,
  CASE WHEN t.v IS NOT NULL THEN 'daily_value' ELSE 'intervals' END AS basis FROM t FULL JOIN a ON t.owner = a.owner AND t.d = a.d AND t.pos = a.pos""")
def daily_or_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(measurements(spark, sf_dir), POOL)
    reported = within.daily(g.where("id % 3 = 0"), GROUPED)
    return within.prefer_reported(reported, within.additive(g, GROUPED), GROUPED).select(*GROUPED, F.round("value", 4).alias("value"), "basis")


@query("ag5_daily_summary", """
SELECT owner, d AS local_date, max_by(value, (k >= 50, s, id)) AS value FROM m GROUP BY ALL""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within.daily_summary(measurements(spark, sf_dir), DAY, F.col("k") >= 50)


@query("ag6_latest_reading", """, c AS (SELECT owner, d, s // 7200000000 AS reading, source, s, id, value FROM m),
o AS (SELECT owner, d, reading, source, max_by(value, (s, id)) AS value, max(s) AS s FROM c GROUP BY ALL),
w AS (SELECT owner, d, reading, max(s) AS s, string_agg(source || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY source) AS parts FROM o GROUP BY ALL)
SELECT owner, d AS local_date, max_by(reading, (s, reading)) AS reading, max_by(parts, (s, reading)) AS parts FROM w GROUP BY ALL""")
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("reading", within.bucket_of("start_at", 7_200_000_000))
    one = within.latest(m, [*DAY, "reading", "source"]).withColumnRenamed("at", "start_at")
    got = within.latest_reading(one, DAY, "reading", "source")
    parts = F.transform(F.array_sort(F.map_entries("components")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("long").cast("string")))
    return got.select(*DAY, "reading", F.array_join(parts, ";").alias("parts"))


@query("ag7_latest_as_of", """
SELECT owner, source, max_by(value, (s, id)) AS value, max(s) AS "at", max_by(id, (s, id)) AS id FROM m WHERE s <= 1705320000000000 GROUP BY ALL""")
def latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.timestamp_micros(F.lit(1_705_320_000_000_000))
    return within.latest(measurements(spark, sf_dir), ["owner", "source"], as_of).withColumn("at", F.unix_micros("at"))


_SIX = """, b AS (SELECT owner, d, source, s // 3600000000 AS b, avg(value) AS mean FROM m GROUP BY ALL), c AS (SELECT owner, d, b, avg(mean) AS m FROM b GROUP BY ALL)"""


@query("ag12_lowest_bucket", _SIX + """
SELECT owner, d AS local_date, round(min(m), 6) AS value, min_by(b, (m, b)) AS b FROM c GROUP BY ALL""")
def lowest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within.lowest_bucket(measurements(spark, sf_dir), DAY, 3_600_000_000).select(*DAY, _r("value"), "b")


@query("ag13_lowest_rolling_mean", _SIX + """, r AS (SELECT owner, d, b, (m + lag(m) OVER w) / 2 AS v, b - lag(b) OVER w AS step FROM c WINDOW w AS (PARTITION BY owner, d ORDER BY b)),
f AS (SELECT owner, d, b, v FROM r WHERE step = 1), l AS (SELECT owner, d, min(v) AS low FROM f GROUP BY ALL)
SELECT f.owner, f.d AS local_date, round(min_by(v, b), 5) AS value, min(b) - 1 AS b FROM f JOIN l USING (owner, d) WHERE v <= low + 1e-9 GROUP BY ALL""")
def lowest_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = within.lowest_rolling_mean(measurements(spark, sf_dir), DAY, 2, 3_600_000_000)
    return got.select(*DAY, F.round("value", 5).alias("value"), "b")


@query("ag14_ag15_wear_gate", """, w AS (SELECT DISTINCT owner, source, s // 3600000000 AS b FROM m WHERE source IN ('click', 'purchase') AND id % 2 = 0), r AS (SELECT DISTINCT owner, source FROM w)
SELECT m.owner, m.source, CASE WHEN r.owner IS NULL THEN 'exempt' WHEN w.owner IS NULL THEN 'not_worn' ELSE 'counted' END AS state, count(*) AS n, round(sum(value), 6) AS total
FROM m LEFT JOIN r USING (owner, source) LEFT JOIN w ON w.owner = m.owner AND w.source = m.source AND w.b = m.s // 3600000000 GROUP BY ALL""")
def wear_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    hour = 3_600_000_000
    wear = m.where("source in ('click', 'purchase') and id % 2 = 0").select("owner", "source", within.bucket_of("start_at", hour).alias("b"))
    return within.worn(m, wear, ["owner"], hour).groupBy("owner", "source", "state").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("ag16_wear_buckets", """
SELECT DISTINCT owner, source, s // 300000000 AS b FROM m""")
def wear_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).select("owner", "source", within.bucket_of("start_at").alias("b")).distinct()


@query("ag17_reporting_days", """
SELECT owner, source, CAST(count(DISTINCT s // 86400000000) AS BIGINT) AS days FROM m GROUP BY ALL""")
def reporting_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).groupBy("owner", "source").agg(F.countDistinct(F.date_trunc("day", "start_at")).alias("days"))


_AT = f""", v AS (SELECT owner, d, {_POS3} AS pos, avg(value) AS value, max(s) AS t_at, min(s) AS t_first, count(*) AS n FROM m WHERE {_POS3} IS NOT NULL GROUP BY ALL)"""


def timed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(measurements(spark, sf_dir), POOL)
    return g.groupBy(*GROUPED).agg(F.avg("value").alias("value"), F.max(F.unix_micros("start_at")).alias("at"), F.min(F.unix_micros("start_at")).alias("first"), F.count("*").alias("n"))


@query("st2_latest_and_earliest", _AT + """
SELECT owner, d AS local_date, round(max_by(value, (t_at, -pos)), 6) AS latest, CAST(max_by(pos, (t_at, -pos)) AS INTEGER) AS latest_pos,
  round(min_by(value, (t_first, pos)), 6) AS earliest, CAST(min_by(pos, (t_first, pos)) AS INTEGER) AS earliest_pos FROM v GROUP BY ALL""")
def latest_and_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = strategy.gates(timed_values(spark, sf_dir))
    return strategy.across(v, DAY).select(*DAY, _r("latest"), "latest_pos", _r("earliest"), "earliest_pos")


_POOLED = _AT + """, x AS (SELECT *, value BETWEEN 20 AND 80 AS ok FROM v), n AS (SELECT owner, d, count(*) FILTER (ok) AS k, avg(value) FILTER (ok) AS a, max(value) FILTER (ok) AS h, min(value) FILTER (ok) AS l, sum(value) FILTER (ok) AS t FROM x GROUP BY ALL)"""


@query("st3_pools", _POOLED + """
SELECT owner, d AS local_date, round(a, 6) AS mean, round(h, 6) AS high, round(l, 6) AS low, round(t, 6) AS total, k AS sources, CASE WHEN k = 0 THEN 'no_data' ELSE 'calculated' END AS status, CASE WHEN k = 1 THEN 'insufficient_sources' END AS warning FROM n""")
def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools over valid groups; too few of them are used with a warning, and a day without any is listed."""
    v = strategy.gates(timed_values(spark, sf_dir), 20, 80)
    out = strategy.pools(v, DAY, {"mean": "mean", "high": "max", "low": "min", "total": "sum"}, 2)
    return out.select(*DAY, *[_r(c) for c in ("mean", "high", "low", "total")], "sources", "status", "warning")


@query("st3_pools_without_value", _POOLED + """
SELECT owner, d AS local_date, round(CASE WHEN k >= 2 THEN a END, 6) AS value, k AS sources, CASE WHEN k < 2 THEN 'no_data' ELSE 'calculated' END AS status, CASE WHEN k = 1 THEN 'insufficient_sources' END AS warning FROM n""")
def pools_without_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.pool(strategy.gates(timed_values(spark, sf_dir), 20, 80), DAY, "mean", 2, use_available=False).select(*DAY, _r("value"), "sources", "status", "warning")


@query("st5_group_gates", f""", r AS (SELECT owner, d, {_POS3} AS pos, value, s, CASE WHEN flags & 1 <> 0 THEN 'flagged' WHEN value NOT BETWEEN 2 AND 90 THEN 'implausible' END AS gone FROM m WHERE {_POS3} IS NOT NULL),
w AS (SELECT DISTINCT owner, d FROM r), sp AS (SELECT owner, d, unnest([0, 1, 2]) AS pos FROM w),
v AS (SELECT owner, d, pos, sum(value) FILTER (gone IS NULL) AS value, count(*) FILTER (gone IS NULL) AS n, max(s) FILTER (gone IS NULL) AS t_at, count(*) FILTER (gone = 'flagged') AS fl, count(*) FILTER (gone = 'implausible') AS im FROM r GROUP BY ALL)
SELECT owner, d AS local_date, CAST(pos AS INTEGER) AS pos, CASE WHEN value IS NULL THEN CASE WHEN im > 0 THEN 'implausible' WHEN fl > 0 THEN 'flagged' ELSE 'no_data' END WHEN value NOT BETWEEN 5 AND 150 THEN 'implausible'
  WHEN least(1.0, n / 3.0) < 0.5 THEN 'below_coverage' WHEN t_at < 1704412800000000 THEN 'stale' END AS reason FROM sp LEFT JOIN v USING (owner, d, pos)""")
def group_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of groups in order; a group that the row gates emptied says which one did."""
    g = grouped(measurements(spark, sf_dir), POOL).withColumn("gone", assign.row_gate(1, 2.0, 90.0))
    left = F.col("gone").isNull()
    v = g.groupBy(*GROUPED).agg(F.sum(F.when(left, F.col("value"))).alias("value"), F.count_if(left).alias("n"), F.max(F.when(left, F.unix_micros("start_at"))).alias("at"), F.count_if(F.col("gone") == "flagged").alias("flagged"), F.count_if(F.col("gone") == "implausible").alias("implausible"))
    listed = strategy.spine(g.select(*DAY).distinct(), len(POOL)).join(v, GROUPED, "left").withColumn("coverage", F.least(F.lit(1.0), F.col("n") / 3.0))
    return strategy.gates(listed, 5, 150, 0.5, F.col("at"), F.lit(1_704_412_800_000_000)).select(*GROUPED, "reason")


_FIRST = """, f AS (SELECT owner, d, min(pos) AS selected, min_by(value, pos) AS value FROM v GROUP BY ALL)"""


@query("st8_definition_changed", _AT + _FIRST + """
SELECT owner, d AS local_date, CAST(selected AS INTEGER) AS selected, coalesce(lag(selected) OVER (PARTITION BY owner ORDER BY d) <> selected, false) AS changed FROM f""")
def definition_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = strategy.first_available(strategy.gates(timed_values(spark, sf_dir)), DAY)
    return strategy.definition_changed(first, ["owner"], "local_date").select(*DAY, "selected", "changed")


@query("st9_contexts", _AT + """, c AS (SELECT DISTINCT owner, d FROM m WHERE source = 'error'),
o AS (SELECT v.*, CASE WHEN c.owner IS NULL THEN pos ELSE [2, 1, 0][pos + 1] END AS ladder FROM v LEFT JOIN c USING (owner, d))
SELECT owner, d AS local_date, round(min_by(value, ladder), 6) AS value, CAST(min_by(pos, ladder) AS INTEGER) AS selected FROM o GROUP BY ALL""")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    found = m.where("source = 'error'").select(*DAY).distinct().withColumn("context", F.lit("workout"))
    v = strategy.reorder(timed_values(spark, sf_dir), found, DAY, {"workout": [2, 1, 0]})
    return v.groupBy(*DAY).agg(F.round(F.min_by("value", "ladder"), 6).alias("value"), F.min_by("pos", "ladder").alias("selected"))


@query("st12_follow", _AT + f""", l AS (SELECT owner, d, min(pos) AS led FROM (SELECT owner, d, 2 - {_POS3} AS p, {_POS3} AS pos FROM m WHERE k >= 50 AND {_POS3} IS NOT NULL) GROUP BY ALL), f AS (SELECT owner, d, min(pos) AS own, min_by(value, pos) AS value FROM v GROUP BY ALL)
SELECT f.owner, f.d AS local_date, round(coalesce(v.value, f.value), 6) AS value, CAST(CASE WHEN v.value IS NOT NULL THEN led ELSE own END AS INTEGER) AS selected,
  CASE WHEN v.value IS NOT NULL THEN 'direct' ELSE 'fallback' END AS status, CASE WHEN v.value IS NULL THEN 'follow_unavailable' END AS warning
FROM f LEFT JOIN l ON l.owner = f.owner AND l.d = f.d LEFT JOIN v ON v.owner = f.owner AND v.d = f.d AND v.pos = l.led""")
def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    leader = grouped(measurements(spark, sf_dir).where("k >= 50"), POOL).groupBy(*DAY).agg(F.min("pos").alias("selected"))
    return strategy.follow(strategy.gates(timed_values(spark, sf_dir)), leader, DAY).select(*DAY, _r("value"), "selected", "status", "warning")


_COMPOSE = LOCAL_HOURS + f""", g AS (SELECT *, {_POS3} AS pos FROM m WHERE {_POS3} IS NOT NULL),
hv AS (SELECT owner, lh.d AS d, hs, pos, sum(value) AS value, count(*) AS n FROM g JOIN lh ON lh.z = zone AND s >= hs AND s < he GROUP BY ALL),
gv AS (SELECT *, CASE WHEN value < 10 THEN 'below_quality' END AS bad, least(1.0, n / 2.0) AS cov FROM hv),
cd AS (SELECT DISTINCT owner, d FROM gv), hrs AS (SELECT owner, cd.d, hs, (he - hs) AS len FROM cd JOIN (SELECT DISTINCT owner, zone FROM m) USING (owner) JOIN lh ON lh.z = zone AND lh.d = cd.d),
full_ AS (SELECT hrs.owner, hrs.d, hrs.hs, p.pos, gv.value, gv.cov, len, CASE WHEN gv.value IS NULL THEN 'no_data' ELSE bad END AS reason FROM hrs CROSS JOIN (SELECT unnest([0, 1, 2]) AS pos) p LEFT JOIN gv ON gv.owner = hrs.owner AND gv.d = hrs.d AND gv.hs = hrs.hs AND gv.pos = p.pos),
pick AS (SELECT owner, d, hs, min(pos) AS sel, min_by(value, pos) AS value FROM full_ WHERE reason IS NULL GROUP BY ALL),
grp AS (SELECT f.owner, f.d, f.pos, max(CASE WHEN f.pos = sel THEN 5 WHEN reason IS NULL THEN 4 WHEN reason = 'no_data' THEN 1 ELSE 3 END) AS rk, sum(f.value) FILTER (reason IS NULL) AS own, sum(coalesce(cov, 0) * len) / sum(len) AS cov, count(*) FILTER (f.pos = sel) AS sup FROM full_ f LEFT JOIN pick p ON p.owner = f.owner AND p.d = f.d AND p.hs = f.hs GROUP BY ALL),
day AS (SELECT owner, d, sum(value) AS value, count(*) AS hours, count(DISTINCT sel) AS groups, max(sel) AS one, bool_and(sel = 0) AS direct FROM pick GROUP BY ALL), most AS (SELECT owner, d, max(coalesce(own, 0)) AS most FROM grp GROUP BY ALL)"""


@query("st13_compose_hours", _COMPOSE + """
SELECT grp.owner, grp.d AS local_date, CAST(pos AS INTEGER) AS pos, ['no_data', 'stale', 'below_quality', 'unused', 'selected'][rk] AS group_status, round(own, 6) AS group_value, round(cov, 6) AS group_coverage, sup > 0 AS supplied, round(value, 6) AS value, coalesce(hours, 0) AS hours, coalesce(groups, 0) AS groups,
  CAST(CASE WHEN groups = 1 THEN one END AS INTEGER) AS selected, CASE WHEN hours IS NULL THEN 'no_data' WHEN groups = 1 THEN CASE WHEN direct THEN 'direct' ELSE 'fallback' END ELSE 'calculated' END AS status, coalesce(groups > 1 AND value > most + 1e-9, false) AS exceeds
FROM grp LEFT JOIN day ON day.owner = grp.owner AND day.d = grp.d JOIN most ON most.owner = grp.owner AND most.d = grp.d""")
def compose_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days composed of their local hours, with what each group did in them."""
    return composed(spark, sf_dir).select(*GROUPED, "group_status", _r("group_value"), _r("group_coverage"), "supplied", _r("value"), "hours", "groups", "selected", "status", "exceeds")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(measurements(spark, sf_dir), POOL).withColumn("t", F.unix_micros("start_at"))
    v = windows.local_parts(g.drop("local_date"), "t", "t").groupBy("owner", "local_date", F.col("hour_start").alias("hour"), "pos").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    at = windows.day_bounds(v.withColumn("zone", zone_of(F.col("owner"))))
    lo, hi = F.unix_micros("day_start"), F.unix_micros("day_end")
    listed = at.select(*GROUPED, "hour", "value", F.least(F.lit(1.0), F.col("n") / 2.0).alias("coverage"), (F.least(F.col("hour") + 3_600_000_000, hi) - F.col("hour")).alias("elapsed"), (hi - lo).alias("day"))
    return strategy.compose(strategy.gates(listed, 10, 1e9), DAY, len(POOL))


_FALLBACK = _COMPOSE + f""", lone AS (SELECT owner, d, pos FROM (SELECT owner, d, {_POS3} AS pos, k FROM m WHERE {_POS3} IS NOT NULL) GROUP BY ALL HAVING min(k) >= 40),
dv AS (SELECT g.owner, g.d, g.pos, max_by(value, (s, id)) AS value FROM g JOIN lone ON lone.owner = g.owner AND lone.d = g.d AND lone.pos = g.pos GROUP BY ALL), dd AS (SELECT owner, d, min(pos) AS dp, min_by(value, pos) AS dv FROM dv GROUP BY ALL),
lead_ AS (SELECT owner, d, min(pos) AS p FROM grp WHERE sup > 0 GROUP BY ALL), base AS (SELECT owner, d FROM cd),
o AS (SELECT base.owner, base.d, day.value, day.hours, groups, one, direct, p, dp, dd.dv, dp IS NOT NULL AND (p IS NULL OR dp < p) AS use FROM base LEFT JOIN day ON day.owner = base.owner AND day.d = base.d LEFT JOIN lead_ ON lead_.owner = base.owner AND lead_.d = base.d LEFT JOIN dd ON dd.owner = base.owner AND dd.d = base.d)"""


@query("st14_daily_fallback", _FALLBACK + """
SELECT owner, d AS local_date, round(CASE WHEN use THEN dv ELSE value END, 6) AS value, CAST(CASE WHEN use THEN dp WHEN groups = 1 THEN one END AS INTEGER) AS selected,
  CASE WHEN use THEN CASE WHEN dp = 0 THEN 'direct' ELSE 'fallback' END WHEN hours IS NULL THEN 'no_data' WHEN groups = 1 THEN CASE WHEN direct THEN 'direct' ELSE 'fallback' END ELSE 'calculated' END AS status, use AS from_daily, CAST(CASE WHEN use THEN dp ELSE 0 END AS INTEGER) AS skipped FROM o""")
def daily_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed day is the daily value of a group with nothing else that stands before all suppliers; rows of long kind stand for daily values."""
    return strategy.daily_fallback(composed(spark, sf_dir), _lone(spark, sf_dir), DAY).select(*DAY, _r("value"), "selected", "status", "from_daily", "skipped")


def _lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(measurements(spark, sf_dir), POOL)
    return g.groupBy(*GROUPED).agg(F.min("k").alias("least"), F.max_by("value", F.struct("start_at", "id")).alias("value")).where("least >= 40")


@query("st14_group_states", _FALLBACK + """ SELECT grp.owner, grp.d AS local_date, CAST(grp.pos AS INTEGER) AS pos, CASE WHEN o.use AND grp.pos = o.dp THEN 'selected' WHEN o.use AND rk = 5 THEN 'unused' ELSE ['no_data', 'stale', 'below_quality', 'unused', 'selected'][rk] END AS group_status FROM grp LEFT JOIN o ON o.owner = grp.owner AND o.d = grp.d""")
def group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group did on a day, once the daily value of another has taken the place of its hours."""
    days = Scratch(spark, "states").save(composed(spark, sf_dir))
    decided = strategy.daily_fallback(days, _lone(spark, sf_dir), DAY)
    return strategy.fallback_groups(days, decided, DAY)


@query("st15_overrides", _AT.replace("FROM m WHERE", "FROM m WHERE id % 50 <> 0 AND") + """, f AS (SELECT owner, d, min_by(value, pos) AS computed FROM v GROUP BY ALL)
SELECT f.owner, f.d AS local_date, round(computed, 6) AS computed, round(CASE WHEN f.owner % 10 = 3 THEN 42.0 WHEN v.value IS NOT NULL THEN v.value ELSE computed END, 6) AS value,
  CASE WHEN f.owner % 10 = 3 THEN 'set_value' WHEN v.value IS NOT NULL THEN 'force_source' END AS override
FROM f LEFT JOIN v ON v.owner = f.owner AND v.d = f.d AND v.pos = 1 AND f.owner % 5 = 0""")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    kept = strategy.exclude_inputs(m, m.where("id % 50 = 0"), ["id"])
    v = grouped(kept, POOL).groupBy(*GROUPED).agg(F.avg("value").alias("value"))
    v = strategy.gates(v)
    days = v.select(*DAY).distinct()
    forced, fixed = days.where("owner % 5 = 0").withColumn("pos", F.lit(1)), days.where("owner % 10 = 3").withColumn("value", F.lit(42.0))
    return strategy.apply_overrides(strategy.first_available(v, DAY), v, forced, fixed, DAY).select(*DAY, _r("computed"), _r("value"), "override")


_BOUNDS = """, w AS (SELECT DISTINCT owner, d, zone, epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE zone) AS lo, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE zone) AS hi FROM m)"""


@query("wn1_local_windows", _BOUNDS + """
SELECT m.owner, m.d AS local_date, (s - lo) // 1800000000 AS slot, count(*) AS n, round(avg(value), 6) AS value FROM m JOIN w USING (owner, d) GROUP BY ALL""")
def local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = windows.day_bounds(measurements(spark, sf_dir)).withColumn("slot", windows.slot_of("start_at", "day_start", 30))
    return m.groupBy(*DAY, "slot").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("wn2_hours_of_local_days", f"""WITH w AS (SELECT d, z, epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE z) AS lo, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE z) AS hi
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT unnest({list(ZONES)!r}) AS z))
SELECT z AS zone, d AS local_date, CAST((hi - lo) // 3600000000 AS BIGINT) AS hours, lo AS starts FROM w""", events=False)
def hours_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("local_date")).distinct()
    days = windows.day_bounds(days.select("local_date", F.explode(F.array(*[F.lit(z) for z in ZONES])).alias("zone")))
    hours = windows.day_windows(days, 60)
    return hours.groupBy("zone", "local_date").agg(F.count("*").alias("hours"), F.min(F.unix_micros("start")).alias("starts"))


@query("wn4_night_dates", """, l AS (SELECT *, (make_timestamp(e) AT TIME ZONE 'UTC') AT TIME ZONE zone AS t FROM m)
SELECT owner, CAST(CASE WHEN hour(t) * 60 + minute(t) >= 1080 THEN CAST(t AS DATE) + 1 ELSE CAST(t AS DATE) END AS DATE) AS night, count(*) AS n FROM l GROUP BY ALL""")
def night_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.functions.scalars import night_of

    local = F.from_utc_timestamp(F.col("end_at"), F.col("zone"))
    return measurements(spark, sf_dir).groupBy("owner", night_of(local).alias("night")).agg(F.count("*").alias("n"))


@query("wn10_window_keys", """
SELECT strftime(make_timestamp(s // 3600000000 * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS window_key, count(*) AS n FROM m GROUP BY ALL""")
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.functions.scalars import window_key

    return measurements(spark, sf_dir).groupBy(window_key(F.date_trunc("hour", "start_at")).alias("window_key")).agg(F.count("*").alias("n"))


_SPANS = """, i AS (SELECT *, max(e) OVER (PARTITION BY owner, source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY owner, source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i),
f AS (SELECT owner, source, CAST(island AS BIGINT) AS island, min(s) AS lo, max(e) AS hi, count(*) AS pieces FROM j GROUP BY ALL)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    return m.select("id", "owner", "source", F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"))


@query("ev1_fragments", _SPANS + " SELECT * FROM f")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.fragments(spans(spark, sf_dir), ["owner", "source"])


@query("ev4_covered_time", """, i AS (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i),
f AS (SELECT owner, island, max(e) - min(s) AS length FROM j GROUP BY ALL)
SELECT owner, CAST(sum(length) AS BIGINT) AS length FROM f GROUP BY ALL""")
def covered_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.covered(spans(spark, sf_dir), ["owner"])


def zones_of_owners(m: DataFrame) -> DataFrame:
    """Each owner lives in their zone, and from the tenth of January on in the next one."""
    owners = m.select("owner").distinct()
    return owners.select("owner", zone_of(F.col("owner")).alias("zone"), F.to_timestamp(F.lit("2024-01-02")).alias("valid_from")).union(
        owners.select("owner", zone_of(F.col("owner") + 1), F.to_timestamp(F.lit("2024-01-10")))
    )


@query("ld2_timeline", f""", t AS (SELECT *, ({list(ZONES)!r})[1 + (owner + CASE WHEN s >= 1704844800000000 THEN 1 ELSE 0 END) % 3] AS z FROM m)
SELECT owner, CAST((make_timestamp(s) AT TIME ZONE 'UTC') AT TIME ZONE z AS DATE) AS local_date, count(*) AS n FROM t GROUP BY ALL""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).drop("zone", "local_date")
    at = windows.zone_at(m, zones_of_owners(m), ["owner"], "start_at")
    return at.groupBy("owner", F.to_date(F.from_utc_timestamp("start_at", F.col("zone"))).alias("local_date")).agg(F.count("*").alias("n"))
