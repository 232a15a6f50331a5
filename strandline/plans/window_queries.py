"""Queries over windows, coverage and what stands around a resolved value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import assign, joins, sleep, strategy, windows, within
from strandline.plans.gold_queries import LOCAL_HOURS
from strandline.plans.registry import query
from strandline.plans.resolution import _AT, _DAYS3, _POS2, _POS3, DAY, GROUPED, LADDER, POOL, day_values, grouped, timed_values, zones_of_owners
from strandline.plans.sleep_queries import _EPISODES, KEYS, PEOPLE, sessions
from strandline.sources.tables import ZONES, measurements, table, zone_of

DAY_US, NOW = 86_400_000_000, 1_705_320_000_000_000


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with a kind: some are daily values, some last, the others are samples."""
    m = measurements(spark, sf_dir)
    kind = F.when(F.col("k") >= 90, "daily_value").when(F.col("source").isin("purchase", "error"), "interval").otherwise("sample")
    lo = F.unix_micros("start_at")
    return m.select("id", "owner", "local_date", kind.alias("kind"), "value", lo.alias("lo"), F.when(kind == "interval", F.unix_micros("end_at")).otherwise(lo).alias("hi"))


_KINDS = """, kd AS (SELECT id, owner, zone, d, value, s AS lo, CASE WHEN k >= 90 THEN 'daily_value' WHEN source IN ('purchase', 'error') THEN 'interval' ELSE 'sample' END AS kind, CASE WHEN k < 90 AND source IN ('purchase', 'error') THEN e ELSE s END AS hi FROM m)"""


@query("fp8_sc2_rows_in_days", _KINDS + """, dw AS (SELECT DISTINCT owner, d FROM m) SELECT kd.owner, kd.d AS local_date, kind, count(*) AS n FROM kd JOIN dw USING (owner, d) GROUP BY ALL""")
def rows_in_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kinds(spark, sf_dir)
    days = rows.select("owner", "local_date").distinct()
    return windows.rows_in(rows, days, ["owner"], "local_day").groupBy(*DAY, "kind").agg(F.count("*").alias("n"))


@query("fp8_rows_in_hours", LOCAL_HOURS + _KINDS + """, hw AS (SELECT DISTINCT owner, zone FROM m), w AS (SELECT owner, hs, he FROM hw JOIN lh ON lh.z = zone)
SELECT kd.owner, hs AS start, count(*) AS n, count(*) FILTER (kind = 'interval') AS intervals FROM kd JOIN w ON w.owner = kd.owner AND kind <> 'daily_value' AND CASE WHEN hi > lo THEN lo < he AND hi > hs ELSE lo >= hs AND lo < he END GROUP BY ALL""")
def rows_in_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kinds(spark, sf_dir)
    span = rows.groupBy("owner").agg(F.date_sub(F.min("local_date"), 1).alias("a"), F.date_add(F.max("local_date"), 1).alias("b"))
    days = windows.day_bounds(span.select("owner", F.explode(F.sequence("a", "b")).alias("local_date")).withColumn("zone", zone_of(F.col("owner"))))
    hours = windows.day_windows(days, 60).select("owner", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))
    return windows.rows_in(rows, hours, ["owner"], "hour").groupBy("owner", "start").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "interval").alias("intervals"))


@query("wn6_jn11_latest_windows", f""", w AS (SELECT DISTINCT owner, least(epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE zone), {NOW}) AS as_of FROM m),
r AS (SELECT w.owner, as_of, m.id, m.s, m.value FROM w ASOF_MARK)
SELECT w.owner, as_of, max_by(m.id, (m.s, m.id)) AS id, max_by(m.value, (m.s, m.id)) AS value FROM w LEFT JOIN m ON m.owner = w.owner AND m.source = 'view' AND m.s <= as_of AND m.s >= as_of - {5 * DAY_US} GROUP BY ALL""".replace("""r AS (SELECT w.owner, as_of, m.id, m.s, m.value FROM w ASOF_MARK)
""", "").replace("zone), " + str(NOW) + ") AS as_of FROM m),", "zone), " + str(NOW) + ") AS as_of FROM m)"))
def latest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row at or before the end of each day, or now, five days back at most."""
    m = measurements(spark, sf_dir)
    ends = windows.day_bounds(m.select("owner", "zone", "local_date").distinct()).select("owner", F.least(F.unix_micros("day_end"), F.lit(NOW)).alias("as_of")).distinct()
    rows = m.where("source = 'view'").select("owner", F.unix_micros("start_at").alias("s"), "id", "value")
    got = joins.as_of(ends, rows, ["owner"], "as_of", ["s", "id"], lookback=5 * DAY_US)
    return got.select("owner", "as_of", "found.id", "found.value")


@query("wn7_readings", """, g AS (SELECT owner, s, CASE WHEN k % 3 = 0 THEN 'g:' || CAST(owner * 1000 + k AS VARCHAR) ELSE 'm:' || CAST(id AS VARCHAR) END AS key FROM m)
SELECT owner, key, min(s) AS start, count(*) AS n FROM g GROUP BY ALL""")
def reading_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("s", F.unix_micros("start_at")).withColumn("g", F.when(F.col("k") % 3 == 0, F.col("owner") * 1000 + F.col("k")))
    return windows.readings(m, ["owner"], "g", "id", "s")


_ZONE = lambda t: f"(CASE WHEN {t} >= 1704844800000000 THEN ({list(ZONES)!r})[1 + (owner + 1) % 3] ELSE ({list(ZONES)!r})[1 + owner % 3] END)"


@query("wn8_local_instants", f""", d0 AS (SELECT DISTINCT owner, CAST(DATE '2024-01-07' + CAST(i AS INTEGER) AS DATE) AS d FROM m, (SELECT unnest(range(6)) AS i)),
w AS (SELECT *, CAST(d AS TIMESTAMP) AS wall FROM d0), a AS (SELECT *, {_ZONE("epoch_us(wall)")} AS z1 FROM w), b AS (SELECT *, epoch_us(wall AT TIME ZONE z1) AS t1 FROM a),
c AS (SELECT *, {_ZONE("t1")} AS z2 FROM b), e AS (SELECT *, epoch_us(wall AT TIME ZONE z2) AS t2 FROM c)
SELECT owner, d AS local_date, CASE WHEN z1 <> z2 AND {_ZONE("t2")} = z2 THEN t2 ELSE t1 END AS day_start FROM e""")
def local_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local midnights around a move to another zone."""
    m = measurements(spark, sf_dir)
    days = m.select("owner").distinct().select("owner", F.explode(F.expr("sequence(date '2024-01-07', date '2024-01-12')")).alias("local_date"))
    return windows.local_at(days, zones_of_owners(m), ["owner"], "t").select("owner", "local_date", F.unix_micros("t").alias("day_start"))


@query("wn11_partial_windows", f""", w AS (SELECT DISTINCT owner, d, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE zone) AS e FROM m) SELECT owner, count(*) FILTER (e > {NOW}) AS partial, count(*) AS days FROM w GROUP BY owner""")
def partial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = windows.day_bounds(measurements(spark, sf_dir).select("owner", "zone", "local_date").distinct())
    return days.groupBy("owner").agg(F.count_if(windows.partial(F.unix_micros("day_end"), F.lit(NOW))).alias("partial"), F.count("*").alias("days"))


_CLASSES, _RULES = ("intensive", "additive", "latest", "daily_summary", "sleep_derived"), ("bucket", "hour", "local_day", "local_night", "sleep_episode", "latest", "reading")


@query("wn12_fp12_kinds", f"""WITH p AS (SELECT p_partkey, {list(_CLASSES)!r}[1 + p_partkey % 5] AS agg, {list(_RULES)!r}[1 + p_size % 7] AS rule, p_size % 2 = 0 AS by_date FROM part),
q AS (SELECT *, CASE WHEN rule = 'local_day' THEN 'local_day' WHEN rule = 'local_night' THEN 'local_night' WHEN agg = 'sleep_derived' THEN 'local_night' ELSE 'local_day' END AS daily FROM p)
SELECT p_partkey, daily, CASE WHEN by_date THEN daily WHEN rule = 'bucket' THEN 'bucket' WHEN rule = 'sleep_episode' THEN 'sleep_episode' WHEN agg IN ('latest', 'daily_summary', 'sleep_derived') THEN 'sleep_episode' ELSE 'hour' END AS drill FROM q""", events=False)
def window_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick(_CLASSES, F.col("p_partkey") % 5).alias("agg"), pick(_RULES, F.col("p_size") % 7).alias("rule"), (F.col("p_size") % 2 == 0).alias("by_date"))
    return p.select("p_partkey", windows.daily_kind(F.col("agg"), F.col("rule")).alias("daily"), windows.drill_kind(F.col("agg"), F.col("rule"), F.col("by_date")).alias("drill"))


@query("ld3_changed_range", """SELECT DISTINCT owner, 1704844800000000 AS lo, 1705276800000000 AS hi FROM (SELECT user_id AS owner FROM events) WHERE owner % 2 = 0""", events=False)
def changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the owners put a move off by five days; the others change nothing."""
    m = measurements(spark, sf_dir)
    old = zones_of_owners(m)
    later = F.when((F.col("owner") % 2 == 0) & (F.col("valid_from") == F.lit("2024-01-10").cast("timestamp")), F.lit("2024-01-15").cast("timestamp")).otherwise(F.col("valid_from"))
    return windows.changed_range(old, old.withColumn("valid_from", later), ["owner"])


@query("ld4_recomputed_dates", f""", r AS (SELECT id, owner, s, d, ({list(ZONES)!r})[1 + (owner + 1) % 3] AS z FROM m WHERE id % 4 <> 0 AND s >= 1704844800000000 AND s < 1705708800000000),
n AS (SELECT *, CAST((make_timestamp(s) AT TIME ZONE 'UTC') AT TIME ZONE z AS DATE) AS new_date FROM r) SELECT id, owner, d AS local_date, new_date FROM n WHERE new_date <> d""")
def recomputed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an offset of their own, in the range of an edit, whose date another timeline changes."""
    m = measurements(spark, sf_dir).withColumn("offset", F.when(F.col("id") % 4 == 0, 0))
    got = windows.recompute_dates(m, zones_of_owners(m), ["owner"], "start_at", F.lit(1_704_844_800_000_000), F.lit(1_705_708_800_000_000))
    return got.select("id", "owner", "local_date", "new_date")


@query("ag10_ag11_contributions", f""", w AS (SELECT owner, d, epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE any_value(zone)) AS d0, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE any_value(zone)) AS d1 FROM m GROUP BY owner, d),
r AS (SELECT m.*, {_POS3} AS pos, d0, d1, least(d1, {NOW}) AS stop FROM m JOIN w USING (owner, d) WHERE {_POS3} IS NOT NULL),
f AS (SELECT owner, d, pos, source, min((s, id)) AS f FROM r GROUP BY ALL), so AS (SELECT owner, d, pos, string_agg(source, ',' ORDER BY f) AS sources FROM f GROUP BY ALL)
SELECT owner, d AS local_date, CAST(pos AS INTEGER) AS pos, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS refs, any_value(sources) AS sources, min(s) AS first, max(s) AS last,
  count(DISTINCT CASE WHEN s >= d0 - d0 % 300000000 AND s - s % 300000000 < stop THEN s // 300000000 END) AS covered, CASE WHEN any_value(stop) > any_value(d0) THEN CAST(ceil((any_value(stop) - any_value(d0 - d0 % 300000000)) / 300000000.0) AS BIGINT) ELSE 0 END AS elapsed,
  round(CASE WHEN any_value(stop) > any_value(d0) THEN least(1.0, count(DISTINCT CASE WHEN s >= d0 - d0 % 300000000 AND s - s % 300000000 < stop THEN s // 300000000 END) / ceil((any_value(stop) - any_value(d0 - d0 % 300000000)) / 300000000.0)) ELSE 0.0 END, 6) AS coverage
FROM r JOIN so USING (owner, d, pos) GROUP BY owner, d, pos""")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.day_bounds(grouped(measurements(spark, sf_dir), POOL)).withColumn("_a", F.unix_micros("day_start")).withColumn("_z", F.unix_micros("day_end"))
    got = within.contributions(g, GROUPED, "_a", "_z", F.lit(NOW))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return got.select(*GROUPED, "count", text("refs").alias("refs"), text("sources").alias("sources"), "first", "last", "covered", "elapsed", F.round("coverage", 6).alias("coverage"))


@query("st6_coverage_gate", """SELECT l_orderkey, l_linenumber, ['bucket_means', 'intervals', 'min', 'latest'][1 + l_linenumber % 4] IN ('bucket_means', 'min') OR (l_quantity > 25 AND l_discount > 0.04 AND NOT l_tax > 0.05) AS gated FROM lineitem""", events=False)
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.element_at(F.array(*[F.lit(b) for b in ("bucket_means", "intervals", "min", "latest")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    agg = F.when(F.col("l_quantity") > 25, "additive").otherwise("intensive")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", within.coverage_gated(basis, agg, F.col("l_discount") > 0.04, F.col("l_tax") > 0.05).alias("gated"))


_WORN = f""", g AS (SELECT owner, d, {_POS3} AS pos, source, s, value, s // 3600000000 AS b, id FROM m WHERE {_POS3} IS NOT NULL), dev AS (SELECT DISTINCT owner FROM m WHERE owner % 3 <> 0),
wb AS (SELECT DISTINCT owner, d, s // 3600000000 AS b FROM m WHERE owner % 3 <> 0 AND id % 4 <> 1), pos_ AS (SELECT unnest([0, 1, 2]) AS pos), w AS (SELECT owner, d, pos FROM (SELECT DISTINCT owner, d FROM m), pos_),
v AS (SELECT g.owner, g.d, g.pos, sum(value) FILTER (wb.b IS NOT NULL OR dev.owner IS NULL) AS value, count(*) FILTER (wb.b IS NULL AND dev.owner IS NOT NULL) AS gated FROM g LEFT JOIN dev USING (owner) LEFT JOIN wb ON wb.owner = g.owner AND wb.d = g.d AND wb.b = g.b GROUP BY ALL),
n AS (SELECT owner, d, count(*) AS worn FROM wb GROUP BY ALL),
o AS (SELECT w.owner, w.d, w.pos, value, coalesce(gated, 0) AS gated, CASE WHEN dev.owner IS NOT NULL THEN coalesce(worn, 0) END AS worn FROM w LEFT JOIN v USING (owner, d, pos) LEFT JOIN dev USING (owner) LEFT JOIN n ON n.owner = w.owner AND n.d = w.d)"""


@query("ag15_worn_without_rows", _WORN + """ SELECT owner, d AS local_date, CAST(pos AS INTEGER) AS pos, CASE WHEN worn IS NULL THEN CASE WHEN value IS NULL THEN 'no_data' ELSE 'valid' END WHEN worn = 0 AND (value IS NOT NULL OR gated > 0) THEN 'below_quality' WHEN worn = 0 THEN 'no_data' ELSE 'valid' END AS status,
  CASE WHEN worn = 0 AND (value IS NOT NULL OR gated > 0) THEN 'not_worn' END AS reason, round(CASE WHEN worn > 0 THEN coalesce(value, 0) WHEN worn IS NULL THEN value END, 6) AS value, round(CASE WHEN worn > 0 THEN least(1.0, worn / 24.0) END, 6) AS coverage FROM o""")
def worn_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive values under the wear gate: coverage is the share worn, worn without rows is a measured 0."""
    hour = 3_600_000_000
    m = measurements(spark, sf_dir).withColumn("b", within.bucket_of("start_at", hour))
    worn = m.where("owner % 3 <> 0 and id % 4 <> 1").select(*DAY, "b").distinct().withColumn("_w", F.lit(True))
    reports = F.col("owner") % 3 != 0
    g = grouped(m, POOL).join(worn, [*DAY, "b"], "left")
    kept = F.col("_w") | ~reports
    v = g.groupBy(*GROUPED).agg(F.sum(F.when(kept, F.col("value"))).alias("value"), F.count_if(F.col("_w").isNull() & reports).alias("gated"))
    days = m.select(*DAY).distinct()
    listed = strategy.spine(days, len(POOL)).join(v, GROUPED, "left")
    n = strategy.spine(days.where(reports), len(POOL)).join(worn.groupBy(*DAY).agg(F.count("*").alias("worn")), DAY, "left").select(*GROUPED, F.coalesce("worn", F.lit(0)).alias("worn"))
    return within.worn_additive(listed, n, GROUPED, F.lit(24.0)).select(*GROUPED, "status", "reason", F.round("value", 6).alias("value"), F.round("coverage", 6).alias("coverage"))


_SELECTED = _DAYS3 + """, x AS (SELECT *, least(1.0, buckets / 3.0) AS coverage, min(pos) OVER (PARTITION BY owner, d) AS sel FROM v)"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = strategy.gates(day_values(spark, sf_dir, POOL).withColumn("coverage", F.least(F.lit(1.0), F.col("buckets") / 3.0)))
    return v.join(strategy.first_available(v, DAY).select(*DAY, "selected"), DAY)


@query("ag33_result_coverage", _SELECTED + """ SELECT owner, d AS local_date, round(max(CASE WHEN pos = sel THEN coverage END), 6) AS selected_coverage, round(avg(coverage), 6) AS pooled_coverage FROM x GROUP BY ALL""")
def result_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _selected(spark, sf_dir)
    one = strategy.result_coverage(s.withColumn("group_status", F.when(F.col("pos") == F.col("selected"), "selected").otherwise("unused")), DAY)
    every = strategy.result_coverage(s.withColumn("group_status", F.lit("selected")), DAY).withColumnRenamed("coverage", "pooled")
    return one.join(every, DAY).select(*DAY, F.round("coverage", 6).alias("selected_coverage"), F.round("pooled", 6).alias("pooled_coverage"))


@query("ag34_sources_used", _SELECTED + """, y AS (SELECT owner, sel, min(d) AS f FROM x WHERE pos = sel GROUP BY ALL) SELECT owner, string_agg(CAST(sel AS VARCHAR), ',' ORDER BY f, sel) AS used FROM y GROUP BY owner""")
def sources_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strategy.sources_used(_selected(spark, sf_dir).where("pos = selected"), ["owner"], "local_date")
    return got.select("owner", F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"))


@query("st1_warnings", _SELECTED + """, w AS (SELECT DISTINCT owner, d, sel FROM x) SELECT owner, d AS local_date, CAST(sel AS BIGINT) AS skipped FROM w""")
def skipped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _selected(spark, sf_dir).select(*DAY, "selected").distinct()
    listed = strategy.spine(s, len(POOL))
    return strategy.warnings(listed, DAY).select(*DAY, F.size("warnings").cast("long").alias("skipped"))


@query("st10_night_minimum", _EPISODES + f""", mn AS (SELECT owner, night, start, "end" FROM em WHERE main), hr AS (SELECT owner % {PEOPLE} AS owner, s, value FROM m WHERE source = 'signup'),
bk AS (SELECT mn.owner, night, s // 300000000 AS b, avg(value) AS v FROM mn JOIN hr ON hr.owner = mn.owner AND s >= start AND s < "end" GROUP BY ALL)
SELECT owner, night, round(min(v), 6) AS value, min_by(b, (v, b)) AS b FROM bk GROUP BY ALL""")
def night_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived code: the lowest bucket mean of another metric's rows in the main episode of the night."""
    _, spans = sleep.aligned(sessions(spark, sf_dir), KEYS)
    rows = measurements(spark, sf_dir).where("source = 'signup'").select((F.col("owner") % PEOPLE).alias("owner"), "source", "start_at", "value", F.unix_micros("start_at").alias("s"))
    held = joins.points_in_spans(rows, spans.where("main").select(*KEYS, "start", "end"), ["owner"], "s", ("start", "end"))
    return within.lowest_bucket(held, KEYS).select(*KEYS, F.round("value", 6).alias("value"), "b")


@query("st9_context_events", LOCAL_HOURS + f""", ow AS (SELECT DISTINCT owner, zone FROM m), hw AS (SELECT owner, hs, he FROM ow JOIN lh ON lh.z = zone),
ev AS (SELECT owner, id, s AS lo, e AS hi, CASE source WHEN 'purchase' THEN 0 ELSE 1 END AS sort FROM m WHERE source IN ('purchase', 'error') AND e > s),
c AS (SELECT hw.owner, hs, sort, ev.lo, id FROM hw JOIN ev ON ev.owner = hw.owner AND ev.lo < he AND ev.hi > hs AND 2 * (least(ev.hi, he) - greatest(ev.lo, hs)) >= he - hs)
SELECT owner, hs AS start, CASE WHEN min(sort) = 0 THEN 'workout' ELSE 'sleep' END AS context, min_by(id, (sort, lo, id)) AS event FROM c GROUP BY ALL""")
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that an event covers at least half of: a workout counts before sleep."""
    m = measurements(spark, sf_dir)
    span = m.groupBy("owner").agg(F.date_sub(F.min("local_date"), 1).alias("a"), F.date_add(F.max("local_date"), 1).alias("b"))
    days = windows.day_bounds(span.select("owner", F.explode(F.sequence("a", "b")).alias("local_date")).withColumn("zone", zone_of(F.col("owner"))))
    hours = windows.day_windows(days, 60).select("owner", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))
    events = m.where("source in ('purchase', 'error')").select("owner", F.col("id").alias("event"), F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"), F.when(F.col("source") == "purchase", 0).otherwise(1).alias("sort"))
    met = joins.overlap(hours, events, ["owner"], ("start", "end"), ("lo", "hi")).where("2 * (least(hi, end) - greatest(lo, start)) >= end - start")
    best = met.groupBy("owner", "start").agg(F.min(F.struct("sort", "lo", "event")).alias("r"))
    return best.select("owner", "start", F.when(F.col("r.sort") == 0, "workout").otherwise("sleep").alias("context"), "r.event")


@query("st20_preview", _DAYS3 + f""", ac AS (SELECT owner, d, min_by(value, pos) AS v, min(pos) AS p FROM v WHERE pos < 2 GROUP BY ALL), dr AS (SELECT owner, d, max_by(value, pos) AS v, max(pos) AS p FROM v WHERE pos > 0 GROUP BY ALL)
SELECT coalesce(ac.owner, dr.owner) AS owner, coalesce(ac.d, dr.d) AS local_date, CASE WHEN ac.v IS NULL THEN 'appears' WHEN dr.v IS NULL THEN 'vanishes' WHEN abs(ac.v - dr.v) <= 1e-9 AND ac.p = dr.p THEN 'same' ELSE 'changed' END AS change FROM ac FULL JOIN dr ON ac.owner = dr.owner AND ac.d = dr.d""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a draft rule with another ladder would change, day by day."""
    v = strategy.gates(day_values(spark, sf_dir, POOL))
    draft = strategy.first_available(v.where("pos > 0").withColumn("pos", 2 - F.col("pos")), DAY).withColumn("selected", 2 - F.col("selected"))
    return strategy.preview(strategy.first_available(v.where("pos < 2"), DAY), draft, DAY).select(*DAY, "change")


@query("st21_series_page", _DAYS3 + """, f AS (SELECT owner, d, min_by(value, pos) AS value, min(pos) AS sel, min_by(n, pos) AS n FROM v GROUP BY ALL)
SELECT owner, d AS local_date, round(value, 6) AS value, CAST(sel AS INTEGER) AS selected, CAST(n AS BIGINT) AS n, round(min(value) OVER (PARTITION BY owner), 6) AS low, round(max(value) OVER (PARTITION BY owner), 6) AS high, count(*) OVER (PARTITION BY owner) AS days FROM f WHERE owner <= 3 ORDER BY owner, d""")
def series_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolved series of a few owners with its summary, in order."""
    v = strategy.gates(day_values(spark, sf_dir, POOL).where("owner <= 3"))
    own = v.groupBy(*DAY).agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("selected"), F.min_by("count", "pos").alias("n"))
    total = own.groupBy("owner").agg(F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.count("*").alias("days"))
    return own.join(total, "owner").select(*DAY, F.round("value", 6).alias("value"), "selected", "n", "low", "high", "days").orderBy(*DAY)


@query("st22_drill_down", f""", b AS (SELECT owner, d, source, s // 300000000 AS b, avg(value) AS v, count(*) AS n FROM m GROUP BY ALL)
SELECT b.owner, b.d AS local_date, b.source, CASE WHEN b.source = 'error' THEN 'excluded' WHEN {_POS2.replace('source', 'b.source')} IS NULL THEN 'not_in_rule' ELSE 'used' END AS rule_status, round(avg(v), 6) AS bucket_means, CAST(sum(n) AS BIGINT) AS samples, any_value(refs) AS refs
FROM b JOIN (SELECT owner, d, source, string_agg(CAST(id AS VARCHAR), ',' ORDER BY s, id) AS refs FROM m GROUP BY ALL) r ON r.owner = b.owner AND r.d = b.d AND r.source = b.source GROUP BY b.owner, b.d, b.source""")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a day, inside the rule or not, with its own value and its records."""
    m = measurements(spark, sf_dir)
    keys = [*DAY, "source"]
    own = within.intensive(m.withColumn("own", F.col("source")), [*DAY, "own"]).withColumnRenamed("own", "source")
    refs = m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_at", "id"))), lambda x: x["id"].cast("string")).alias("refs"))
    place = assign.membership(assign.position(LADDER, (assign.Selector(source="error"),)))
    status = F.when(place == "grouped", "used").otherwise(place)
    return own.join(refs, keys).select(*keys, status.alias("rule_status"), F.round("value", 6).alias("bucket_means"), F.col("count").alias("samples"), F.array_join("refs", ",").alias("refs"))
