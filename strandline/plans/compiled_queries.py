"""Values by the rule documents of each owner, all resolved in one plan; the documents are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import compiler, explain, rules
from strandline.plans.registry import query
from strandline.sources import catalogue
from strandline.sources.tables import measurements, table, zone_of

NOW = 1_706_700_000_000_000
KINDS = ("bucket", "hour", "local_day", "local_night", "latest")
OPS = ("first_available", "latest", "earliest", "mean_across_sources", "minimum_across_sources", "maximum_across_sources")
_GROUPS = (
    '[{"id":"g0","match":[{"provider":"view","device_type":"watch"},{"provider":"click"}]},{"id":"g1","match":[{"provider":"purchase"},{"origin_key_prefix":"signup.a","entry":"device"}]},{"id":"g2","match":[{"device_manufacturer":"ACME"}]}]'
)
_EXCLUDE = '[{"provider":"error","relayed":"true"}]'


def _of(items: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of three metrics: samples, intervals with some daily values among them, and readings of several rows."""
    m = measurements(spark, sf_dir)
    metric, lo = F.when(F.col("id") % 3 == 0, "pulse").when(F.col("id") % 3 == 1, "clicks").otherwise("level"), F.unix_micros("start_at")
    flags = F.array_compact(F.array(F.when(F.col("flags").bitwiseAND(1) != 0, "manual_entry"), F.when(F.col("flags").bitwiseAND(2) != 0, "relayed")))
    kind = F.when(metric != "clicks", "sample").when(F.col("id") % 17 == 0, "daily_value").otherwise("interval")
    return m.select(
        "owner", metric.alias("metric"), "id", F.concat("source", F.lit(":"), (F.col("id") % 2).cast("string")).alias("source_id"), kind.alias("kind"), lo.alias("lo"), F.when(kind == "interval", F.unix_micros("end_at")).otherwise(lo).alias("hi"),
        "zone", "local_date", "value", flags.alias("flags"), F.when(F.col("id") % 5 != 0, F.expr("unix_micros(start_at) div 7200000000")).alias("reading"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of every kind of event, a watch and a phone; what the phone of errors sends is relayed."""
    s = table(spark, sf_dir, "events").select("event_type").distinct().withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    watch = F.col("n") == 0
    none = F.lit(None).cast("string")
    return s.select(
        F.concat("event_type", F.lit(":"), F.col("n").cast("string")).alias("source_id"), F.col("event_type").alias("provider"), none.alias("connection_id"), F.concat("event_type", F.when(watch, ".app").otherwise(".other")).alias("origin_key"), none.alias("origin_name"),
        F.when(watch, "false").otherwise("true").alias("relayed"), F.when(watch, "watch").otherwise("phone").alias("device_type"), none.alias("device_model"), F.when(watch, None).otherwise("Acme").alias("device_manufacturer"), none.alias("device_id"), F.lit("device").alias("entry"),
    )


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ten in the evening to six, for each date on which an owner has rows and the one after."""
    m = measurements(spark, sf_dir).select("owner", "zone", F.explode(F.array("local_date", F.date_add("local_date", 1))).alias("night")).distinct()
    midnight = F.unix_micros(F.to_utc_timestamp(F.col("night").cast("timestamp_ntz").cast("timestamp"), F.col("zone")))
    return m.select("owner", "night", (midnight - 7_200_000_000).alias("lo"), (midnight + 21_600_000_000).alias("hi"), F.lit(True).alias("main"))


def _documents(spark: SparkSession, sf_dir: str, metric: str, body: Column) -> DataFrame:
    owners = measurements(spark, sf_dir).select("owner").distinct()
    head = F.concat(F.lit(f'{{"schema":"{rules.VERSION}","metric":"{metric}","exclude":{_EXCLUDE},"groups":{_GROUPS},'), body, F.lit("}"))
    return owners.select(F.concat_ws("/", F.col("owner").cast("string"), F.lit(metric)).alias("rule"), "owner", F.lit(metric).alias("metric"), head.alias("doc"))


def _window(kind: Column) -> Column:
    return F.concat(F.lit('"window":{"kind":"'), kind, F.when(kind == "bucket", '","size":"30m"}').otherwise('"}'))


_ROWS = """, r0 AS (SELECT owner, id, s, e, zone, d, value, flags, source, ['pulse', 'clicks', 'level'][1 + id % 3] AS metric, source || ':' || CAST(id % 2 AS VARCHAR) AS src,
  epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE zone) AS d0, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE zone) AS d1,
  CASE WHEN source = 'error' AND id % 2 = 1 THEN -1 WHEN (source = 'view' AND id % 2 = 0) OR source = 'click' THEN 0 WHEN source = 'purchase' OR (source = 'signup' AND id % 2 = 0) THEN 1 WHEN id % 2 = 1 THEN 2 END AS pos FROM m)"""
_KEY = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%SZ')"
_PULSE = _ROWS + f""", p AS (SELECT *, ['bucket', 'hour', 'local_day', 'local_night', 'latest'][1 + owner % 5] AS kind, (owner // 5) % 6 AS op FROM r0 WHERE metric = 'pulse'),
w AS (
  SELECT *, CASE kind WHEN 'bucket' THEN {_KEY.format('d0 + (s - d0) // 1800000000 * 1800000000')} WHEN 'hour' THEN {_KEY.format('d0 + (s - d0) // 3600000000 * 3600000000')} ELSE CAST(d AS VARCHAR) END AS key FROM p WHERE kind <> 'local_night'
  UNION ALL SELECT *, CAST(d AS VARCHAR) FROM p WHERE kind = 'local_night' AND s - d0 < 21600000000
  UNION ALL SELECT *, CAST(d + 1 AS VARCHAR) FROM p WHERE kind = 'local_night' AND s >= d1 - 7200000000),
okay AS (SELECT * FROM w WHERE pos >= 0 AND value BETWEEN 2 AND 120 AND flags & 1 = 0),
b1 AS (SELECT owner, kind, op, key, pos, src, s // 300000000 AS b, avg(value) AS mean FROM okay GROUP BY ALL), b2 AS (SELECT owner, kind, op, key, pos, b, avg(mean) AS m FROM b1 GROUP BY ALL),
bv AS (SELECT owner, kind, op, key, pos, avg(m) AS value FROM b2 GROUP BY ALL),
t AS (SELECT owner, kind, op, key, pos, max(s) AS at_, min(s) AS first_, max_by(value, (s, id)) AS last_ FROM okay GROUP BY ALL),
v1 AS (SELECT t.owner, t.kind, t.op, t.key, t.pos, CASE WHEN t.kind = 'latest' THEN last_ ELSE value END AS value, at_, first_ FROM t JOIN bv USING (owner, kind, op, key, pos)),
dates AS (SELECT DISTINCT owner, key FROM w WHERE kind = 'latest'),
lv AS (SELECT d.owner, 'latest' AS kind, v1.op, d.key, v1.pos, v1.value, v1.at_, v1.first_ FROM dates d JOIN v1 ON v1.kind = 'latest' AND v1.owner = d.owner AND v1.key <= d.key QUALIFY row_number() OVER (PARTITION BY d.owner, d.key, v1.pos ORDER BY v1.key DESC) = 1),
v AS (SELECT * FROM v1 WHERE kind <> 'latest' UNION ALL SELECT * FROM lv),
f AS (SELECT owner, kind, key, CASE any_value(op) WHEN 0 THEN min_by(value, pos) WHEN 1 THEN max_by(value, (at_, -pos)) WHEN 2 THEN min_by(value, (first_, pos)) WHEN 3 THEN avg(value) WHEN 4 THEN min(value) ELSE max(value) END AS value,
  CASE any_value(op) WHEN 0 THEN min(pos) WHEN 1 THEN max_by(pos, (at_, -pos)) WHEN 2 THEN min_by(pos, (first_, pos)) END AS sel, count(*) AS n FROM v GROUP BY ALL),
a AS (SELECT DISTINCT owner, kind, key, op FROM w)
SELECT a.owner, a.kind AS "window", a.key AS window_key, round(CASE WHEN op < 3 OR n >= 2 THEN value END, 6) AS value, 'g' || CAST(sel AS VARCHAR) AS selected,
  CASE WHEN f.owner IS NULL OR (op >= 3 AND n < 2) THEN 'no_data' WHEN op >= 3 THEN 'calculated' WHEN op > 0 OR sel = 0 THEN 'direct' ELSE 'fallback' END AS status,
  CASE WHEN op = 0 THEN coalesce(sel, 0) WHEN op >= 3 AND n = 1 THEN 1 ELSE 0 END AS warnings
FROM a LEFT JOIN f ON f.owner = a.owner AND f.key = a.key"""


@query("ag1_st16_compiled_rules", _PULSE)
def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of windows and six strategies, by the documents of the owners, in one plan."""
    op = _of(OPS, F.expr("owner div 5"))
    pool = F.col("owner") % 30 >= 15
    strategy = F.concat(F.lit(',"strategy":{"op":"'), op, F.lit('"'), F.when(pool, ',"min_sources":2,"on_insufficient":"no_value"').otherwise(""), F.lit('},"quality":{"plausible_range":[2,120],"exclude_flags":["manual_entry"]}'))
    docs = _documents(spark, sf_dir, "pulse", F.concat(_window(_of(KINDS, F.col("owner"))), strategy))
    got = compiler.resolve(docs, catalogue.metrics(spark), rows(spark, sf_dir), sources(spark, sf_dir), NOW, nights(spark, sf_dir), name="compiled").results
    return got.select("owner", "window", "window_key", F.round("value", 6).alias("value"), "selected", "status", F.size("warnings").alias("warnings"))


_CLICKS = _ROWS + """, c AS (SELECT *, id % 17 = 0 AS daily FROM r0 WHERE metric = 'clicks'),
iv AS (SELECT *, unnest(range(s // 300000000, CASE WHEN e > s THEN (e - 1) // 300000000 ELSE s // 300000000 END + 1)) AS b FROM c WHERE NOT daily AND pos >= 0),
i1 AS (SELECT owner, d, pos, src, b, sum(CASE WHEN e > s THEN value * (least(e, (b + 1) * 300000000) - greatest(s, b * 300000000)) / (e - s) ELSE value END) AS x FROM iv GROUP BY ALL),
i2 AS (SELECT owner, d, pos, b, CASE WHEN owner % 4 = 1 THEN sum(x) ELSE max(x) END AS m FROM i1 GROUP BY owner, d, pos, b), i3 AS (SELECT owner, d, pos, sum(m) AS total FROM i2 GROUP BY ALL),
d1 AS (SELECT owner, d, pos, src, max_by(value, (s, id)) AS x FROM c WHERE daily AND pos >= 0 GROUP BY ALL), d2 AS (SELECT owner, d, pos, CASE WHEN owner % 4 = 1 THEN sum(x) ELSE max(x) END AS m FROM d1 GROUP BY owner, d, pos),
cv AS (SELECT coalesce(i3.owner, d2.owner) AS owner, coalesce(i3.d, d2.d) AS d, coalesce(i3.pos, d2.pos) AS pos, CASE WHEN i3.owner % 2 = 0 OR d2.owner % 2 = 0 THEN coalesce(m, total) ELSE total END AS value FROM i3 FULL JOIN d2 ON i3.owner = d2.owner AND i3.d = d2.d AND i3.pos = d2.pos),
cw AS (SELECT DISTINCT owner, d FROM c), ok AS (SELECT * FROM cv WHERE value BETWEEN 3 AND 150), cr AS (SELECT owner, d, min(pos) AS sel, min_by(value, pos) AS value FROM ok GROUP BY ALL),
l AS (SELECT * FROM r0 WHERE metric = 'level'), lw AS (SELECT DISTINCT owner, d FROM l), lv AS (SELECT owner, d, pos, avg(value) AS mean, max_by(value, (s, id)) AS last_ FROM l WHERE pos >= 0 GROUP BY ALL),
lf AS (SELECT owner, d, pos, CASE WHEN owner % 2 = 0 THEN mean ELSE last_ END AS value FROM lv), ln AS (SELECT owner, d, min(pos) AS sel, min_by(value, pos) AS first_, max(value) AS most FROM lf GROUP BY ALL)"""


@query("ag3_ag4_compiled_days", _CLICKS + """
SELECT cw.owner, cw.d AS date, round(value, 4) AS value, 'g' || CAST(sel AS VARCHAR) AS selected, CASE WHEN cr.owner IS NULL THEN 'no_data' WHEN sel = 0 THEN 'direct' ELSE 'fallback' END AS status FROM cw LEFT JOIN cr USING (owner, d)""")
def compiled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive days by documents: reported or summed, the sources of a group summed or the largest, sums within a range."""
    got = _leading(spark, sf_dir).results.where("metric = 'clicks'")
    return got.select("owner", "date", F.round("value", 4).alias("value"), "selected", "status")


def _leading(spark: SparkSession, sf_dir: str) -> compiler.Resolution:
    """Days of a metric, and those of another that follows it: by a pick for some owners, by a pool for others."""
    intra = F.when(F.col("owner") % 4 == 1, '"intra_group":"sum",').otherwise("")
    policy = F.when(F.col("owner") % 2 == 0, "prefer_reported").otherwise("intervals_only")
    lead = _documents(spark, sf_dir, "clicks", F.concat(F.lit('"window":{"kind":"local_day"},"strategy":{"op":"first_available"},"acknowledged_warnings":["cross_source_sum"],"quality":{"plausible_range":[3,150]},"within_source":{'), intra, F.lit('"daily_value_policy":"'), policy, F.lit('"}')))
    op = F.when(F.col("owner") % 3 == 0, "maximum_across_sources").otherwise("first_available")
    stat = F.when(F.col("owner") % 2 == 0, "mean").otherwise("latest")
    led = _documents(spark, sf_dir, "level", F.concat(F.lit('"window":{"kind":"local_day"},"follow":"clicks","strategy":{"op":"'), op, F.lit('"},"within_source":{"statistic":"'), stat, F.lit('"}')))
    return compiler.resolve(lead.union(led), catalogue.metrics(spark), rows(spark, sf_dir), sources(spark, sf_dir), NOW, name="followed")


@query("st12_compiled_followers", _CLICKS + """
SELECT lw.owner, lw.d AS date, round(CASE WHEN lf.pos IS NOT NULL THEN lf.value WHEN lw.owner % 3 = 0 THEN most ELSE first_ END, 6) AS value,
  CASE WHEN lf.pos IS NOT NULL THEN 'g' || CAST(lf.pos AS VARCHAR) WHEN lw.owner % 3 <> 0 THEN 'g' || CAST(ln.sel AS VARCHAR) END AS selected,
  CASE WHEN lf.pos IS NOT NULL THEN 'direct' WHEN ln.owner IS NULL THEN 'no_data' WHEN lw.owner % 3 = 0 THEN 'calculated' ELSE 'fallback' END AS status
FROM lw LEFT JOIN cr USING (owner, d) LEFT JOIN lf ON lf.owner = lw.owner AND lf.d = lw.d AND lf.pos = cr.sel LEFT JOIN ln ON ln.owner = lw.owner AND ln.d = lw.d""")
def compiled_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers take the leader's group where it is valid; else a pick is a fallback and a pool stays calculated."""
    got = _leading(spark, sf_dir).results.where("metric = 'level'")
    return got.select("owner", "date", F.round("value", 6).alias("value"), "selected", "status")


_HOURS = _ROWS + """, c AS (SELECT *, CASE WHEN id % 17 = 0 THEN s ELSE e END AS e2 FROM r0 WHERE metric = 'clicks' AND id % 17 <> 0),
hs AS (SELECT DISTINCT zone, g AS d, epoch_us(g AT TIME ZONE zone) AS d0, epoch_us((g + INTERVAL 1 DAY) AT TIME ZONE zone) AS d1 FROM (SELECT DISTINCT zone FROM m), generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) t(g)),
lh AS (SELECT zone, CAST(d AS DATE) AS d, h, least(h + 3600000000, d1) AS he FROM (SELECT *, unnest(range(d0, d1, 3600000000)) AS h FROM hs)),
x AS (SELECT c.*, lh.d AS date, lh.h, greatest(s, h) AS a, least(e, he) AS z FROM c JOIN lh ON lh.zone = c.zone AND CASE WHEN e > s THEN s < he AND e > h ELSE s >= h AND s < he END),
y AS (SELECT *, unnest(range(a // 300000000, CASE WHEN e > s THEN (z - 1) // 300000000 ELSE a // 300000000 END + 1)) AS b FROM x WHERE pos >= 0),
y1 AS (SELECT owner, date, h, pos, src, b, sum(CASE WHEN e > s THEN value * (least(z, (b + 1) * 300000000) - greatest(a, b * 300000000)) / (e - s) ELSE value END) AS v FROM y GROUP BY ALL),
y2 AS (SELECT owner, date, h, pos, b, max(v) AS v FROM y1 GROUP BY ALL), y3 AS (SELECT owner, date, h, pos, sum(v) AS v FROM y2 GROUP BY ALL),
pk AS (SELECT owner, date, h, CASE WHEN owner % 2 = 0 THEN min(pos) ELSE min_by(pos, (-v, pos)) END AS sel, CASE WHEN owner % 2 = 0 THEN min_by(v, pos) ELSE max(v) END AS v FROM y3 GROUP BY owner, date, h),
own AS (SELECT owner, date, max(t) AS most FROM (SELECT owner, date, pos, sum(v) AS t FROM y3 GROUP BY ALL) GROUP BY ALL), dd AS (SELECT DISTINCT owner, date FROM x)
SELECT dd.owner, dd.date, round(sum(v), 4) AS value, CASE WHEN count(DISTINCT sel) = 1 THEN 'g' || CAST(max(sel) AS VARCHAR) END AS selected,
  CASE count(DISTINCT sel) WHEN 0 THEN 'no_data' WHEN 1 THEN CASE WHEN max(sel) = 0 AND dd.owner % 2 = 0 THEN 'direct' ELSE 'fallback' END ELSE 'calculated' END AS status, coalesce(count(DISTINCT sel) > 1 AND sum(v) > any_value(most) + 1e-9, false) AS exceeds
FROM dd LEFT JOIN pk USING (owner, date) LEFT JOIN own USING (owner, date) GROUP BY dd.owner, dd.date"""


@query("st13_compiled_compose", _HOURS)
def compiled_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days composed of hours by documents: each hour from the first group, or from the one with most."""
    op = F.when(F.col("owner") % 2 == 0, "first_available").otherwise("max")
    docs = _documents(spark, sf_dir, "clicks", F.concat(F.lit('"window":{"kind":"local_day"},"strategy":{"op":"first_available"},"compose":{"from":"hour","op":"'), op, F.lit('"}')))
    got = compiler.resolve(docs, catalogue.metrics(spark), rows(spark, sf_dir), sources(spark, sf_dir), NOW, name="composed").results
    return got.select("owner", "date", F.round("value", 4).alias("value"), "selected", "status", (F.size("warnings") > 0).alias("exceeds"))


_CONTEXT = _ROWS + """, p AS (SELECT *, d0 + (s - d0) // 3600000000 * 3600000000 AS h FROM r0 WHERE metric = 'pulse'), w AS (SELECT DISTINCT owner, h, least(h + 3600000000, d1) AS he FROM p),
ev AS (SELECT owner, s AS lo, e AS hi, src, pos, source = 'purchase' AS workout FROM r0 WHERE source IN ('purchase', 'view') AND e - s >= 1800000000),
cx AS (SELECT w.owner, w.h, workout, CASE WHEN workout AND pos >= 0 THEN pos END AS rec FROM w JOIN ev ON ev.owner = w.owner AND lo < he AND hi > h AND 2 * (least(he, hi) - greatest(h, lo)) >= he - h QUALIFY row_number() OVER (PARTITION BY w.owner, w.h ORDER BY workout DESC, lo, hi, src) = 1),
b1 AS (SELECT owner, h, pos, src, s // 300000000 AS b, avg(value) AS mean FROM p WHERE pos >= 0 GROUP BY ALL), b2 AS (SELECT owner, h, pos, b, avg(mean) AS m FROM b1 GROUP BY ALL), v AS (SELECT owner, h, pos, avg(m) AS value FROM b2 GROUP BY ALL),
o AS (SELECT v.*, CASE WHEN workout THEN CASE WHEN pos = rec THEN 0 WHEN pos = 2 THEN 1 ELSE 10 + pos END WHEN NOT workout THEN CASE WHEN pos = 1 THEN 0 ELSE 10 + pos END ELSE 10 + pos END AS ladder FROM v LEFT JOIN cx USING (owner, h))
SELECT w.owner, """ + _KEY.format("w.h") + """ AS window_key, CASE WHEN cx.workout THEN 'workout' WHEN NOT cx.workout THEN 'sleep' END AS context, round(min_by(value, ladder), 6) AS value, 'g' || CAST(min_by(pos, ladder) AS VARCHAR) AS selected
FROM w LEFT JOIN cx USING (owner, h) LEFT JOIN o ON o.owner = w.owner AND o.h = w.h GROUP BY w.owner, w.h, cx.workout"""


@query("st9_compiled_contexts", _CONTEXT)
def compiled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which an event covers half or more put the groups that the document lists first, the recorder of a workout among them."""
    docs = _documents(spark, sf_dir, "pulse", F.lit('"window":{"kind":"hour"},"strategy":{"op":"first_available"},"contexts":{"workout":["@workout_source","g2"],"sleep":["g1"]}'))
    m = measurements(spark, sf_dir).where("source in ('purchase', 'view')")
    events = m.select("owner", F.when(F.col("source") == "purchase", "workout").otherwise("sleep").alias("context"), F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"), F.concat("source", F.lit(":"), (F.col("id") % 2).cast("string")).alias("source_id")).where("hi - lo >= 1800000000")
    got = compiler.resolve(docs, catalogue.metrics(spark), rows(spark, sf_dir), sources(spark, sf_dir), NOW, events=events, name="contexts").results
    return got.select("owner", "window_key", "context", F.round("value", 6).alias("value"), "selected")


@query("fp2_selectors", """WITH s AS (SELECT p_partkey AS k, p_brand AS provider, p_type AS cid, 'app.' || p_name AS ok, p_brand AS man, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS typ, p_size % 2 = 0 AS rel FROM part)
SELECT k, CAST(CASE WHEN typ IS NOT NULL AND starts_with(typ, 'PROMO') AND rel AND k % 10 = 3 THEN -1 WHEN k % 5 = 0 AND typ IS NOT NULL THEN 0 WHEN k % 3 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 END AS INTEGER) AS pos FROM s""", events=False)
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources, each under a document of its own whose selectors name some of its fields, some of another's, in all eleven fields."""
    p = table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    src = p.select(
        F.col("p_partkey").cast("string").alias("source_id"), text("p_brand").alias("provider"), text("p_type").alias("connection_id"), F.concat(F.lit("app."), text("p_name")).alias("origin_key"), text("p_name").alias("origin_name"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("relayed"),
        F.when(F.col("p_partkey") % 4 != 0, text("p_type")).alias("device_type"), text("p_brand").alias("device_model"), text("p_brand").alias("device_manufacturer"), text("p_partkey").alias("device_id"), F.when(F.col("p_size") > 25, "device").otherwise("manual").alias("entry"),
    )
    k = F.col("source_id").cast("long")
    one = lambda **f: F.create_map(*[x for name, c in f.items() for x in (F.lit(name), c)])
    typed = F.coalesce("device_type", F.lit("none"))
    group = lambda i, *m: F.struct(F.lit(i).alias("id"), F.array(*m).alias("match"))
    groups = F.array(
        group("a", one(device_type=typed, device_id=F.when(k % 5 == 0, F.col("device_id")).otherwise("0"))),
        group("b", one(provider=F.lit("nobody")), one(origin_key_prefix=F.when(k % 3 == 0, F.left("origin_key", F.lit(6))).otherwise("none."), origin_name=F.col("origin_name"))),
        group("c", one(device_manufacturer=F.when(k % 2 == 0, F.upper("device_manufacturer")).otherwise("?"), connection_id=F.col("connection_id"), entry=F.col("entry"), device_model=F.col("device_model"), origin_key=F.col("origin_key"), provider=F.col("provider"))),
    )
    out = F.array(one(relayed=F.lit("true"), device_type=F.when((k % 10 == 3) & F.startswith(typed, F.lit("PROMO")), typed).otherwise("other")))
    docs = src.select(F.col("source_id").alias("rule"), F.to_json(F.struct(F.lit(rules.VERSION).alias("schema"), F.lit("pulse").alias("metric"), groups.alias("groups"), out.alias("exclude"))).alias("doc"))
    got = compiler.memberships(src, src.select(F.col("source_id").alias("rule"), "source_id"), compiler.predicates(docs))
    return got.select(F.col("source_id").cast("long").alias("k"), "pos")


_TOLD = _ROWS + """, p AS (SELECT *, CASE WHEN flags & 1 <> 0 THEN 'flagged' WHEN value NOT BETWEEN 10 AND 60 THEN 'implausible' ELSE 'ok' END AS gate FROM r0 WHERE metric = 'pulse'),
w AS (SELECT DISTINCT owner, d FROM p), s AS (SELECT owner, d, unnest([0, 1, 2]) AS pos FROM w),
c AS (SELECT owner, d, pos, count(*) FILTER (gate = 'ok') AS n, count(*) FILTER (gate = 'flagged') AS fl, count(*) FILTER (gate = 'implausible') AS im FROM p WHERE pos >= 0 GROUP BY ALL),
g AS (SELECT s.*, CASE WHEN coalesce(n, 0) > 0 THEN NULL WHEN im > 0 THEN 'What g' || CAST(pos AS VARCHAR) || ' has is out of range.' WHEN fl > 0 THEN 'g' || CAST(pos AS VARCHAR) || ' has flagged rows only.' ELSE 'g' || CAST(pos AS VARCHAR) || ' has nothing here.' END AS why FROM s LEFT JOIN c USING (owner, d, pos)),
f AS (SELECT owner, d, min(pos) FILTER (why IS NULL) AS sel, count(*) FILTER (why IS NULL) AS ok FROM g GROUP BY ALL),
t AS (SELECT g.owner, g.d, string_agg(why, ' ' ORDER BY pos) FILTER (why IS NOT NULL AND (pos < sel OR sel IS NULL OR g.owner % 3 = 2)) AS why, string_agg('g' || CAST(pos AS VARCHAR), ', ' ORDER BY pos) FILTER (why IS NULL AND pos <> sel AND g.owner % 3 < 2) AS spare FROM g JOIN f USING (owner, d) GROUP BY ALL)
SELECT f.owner, f.d AS date, array_to_string(list_filter([CASE WHEN ok = 0 THEN 'No source can be used.' WHEN f.owner % 3 = 2 THEN CAST(ok AS VARCHAR) || ' sources combined.' WHEN sel = 0 OR f.owner % 3 = 1 THEN 'Taken from g' || CAST(CASE WHEN f.owner % 3 = 1 THEN sel ELSE sel END AS VARCHAR) || ', the first choice.' ELSE 'Taken from g' || CAST(sel AS VARCHAR) || '.' END,
  why, 'Not needed: ' || spare || '.', CASE WHEN f.owner % 3 = 2 AND ok = 1 THEN 'There are fewer sources than the rule asks for.' END, CASE WHEN f.d >= DATE '2024-01-20' THEN 'The window is still open.' END], lambda x: x IS NOT NULL), ' ') AS explanation
FROM f JOIN t USING (owner, d) WHERE f.owner % 3 <> 1"""


@query("st19_compiled_explanations", _TOLD)
def compiled_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of days that were picked or pooled: where a value is from, why preferred groups aren't used, what wasn't needed."""
    op = F.when(F.col("owner") % 3 == 2, '{"op":"mean_across_sources","min_sources":2}').otherwise('{"op":"first_available"}')
    docs = _documents(spark, sf_dir, "pulse", F.concat(F.lit('"window":{"kind":"local_day"},"quality":{"plausible_range":[10,60],"exclude_flags":["manual_entry"]},"strategy":'), op)).where("owner % 3 <> 1")
    got = compiler.resolve(docs, catalogue.metrics(spark), rows(spark, sf_dir), sources(spark, sf_dir), NOW, name="told")
    days = got.results.withColumn("end", F.unix_micros(F.date_add("date", 1).cast("timestamp")))
    text = explain.windows(days, got.groups, compiler.WINDOW, F.lit(1_705_708_800_000_000))
    return text.join(days.select(*compiler.WINDOW, "owner", "date"), compiler.WINDOW).select("owner", "date", "explanation")
