"""Sleep and workout queries: events that last stand for sessions of a few people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import night_of
from strandline.operators import assign, episodes, sleep
from strandline.plans.registry import query
from strandline.sources.scratch import Scratch
from strandline.sources.tables import ZONES, measurements, zone_of

KEYS = ["owner", "night"]
PEOPLE = 7
# Fixed values of the stand-in rule: two sources in the first group, one in the second, one excluded, one outside.
RULE = (assign.Group("bed", (assign.Selector(source="view"), assign.Selector(source="click"))), assign.Group("watch", (assign.Selector(source="purchase"),)))
EXCLUDE = (assign.Selector(source="error"),)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that lasts as a session, with totals and stages in fixed parts of its length; some lack some of them."""
    m = measurements(spark, sf_dir).where("k > 0").withColumn("owner", F.col("owner") % PEOPLE).withColumn("zone", zone_of(F.col("owner")))
    lo, hi = F.unix_micros("start_at"), F.unix_micros("end_at")
    some = lambda n, c: F.when(F.col("id") % n != 0, c)
    at = lambda share: lo + F.col("k") * share * 1_000_000
    piece = lambda stage, a, b: F.struct(F.lit(stage).alias("stage"), at(a).alias("lo"), at(b).alias("hi"))
    stages = F.array(piece("awake", 0, 6), piece("light", 6, 30), piece("awake", 30, 33), piece("deep", 33, 45), piece("rem", 45, 57))
    return m.select(
        "owner", night_of(F.from_utc_timestamp("end_at", F.col("zone"))).alias("night"), "id", "source", lo.alias("lo"), hi.alias("hi"), (F.col("k") < 20).alias("is_nap"), (F.col("id") % 4 != 0).alias("has_stages"),
        some(11, F.col("k") * 48).alias("asleep"), some(13, F.col("k") * 6).alias("awake"), some(5, F.col("k") * 24).alias("light"), some(6, F.col("k") * 12).alias("deep"), (F.col("k") * 12).alias("rem"),
        F.when(F.col("id") % 3 == 0, F.col("k") * 2).alias("latency"), F.when(F.col("id") % 4 != 0, stages).otherwise(F.slice(stages, 1, 0)).alias("stages"),
    )


_SESSIONS = f""", s0 AS (SELECT owner % {PEOPLE} AS owner, id, source, s AS lo, e AS hi, k, ({list(ZONES)!r})[1 + (owner % {PEOPLE}) % 3] AS z FROM m WHERE k > 0),
s1 AS (SELECT *, (make_timestamp(hi) AT TIME ZONE 'UTC') AT TIME ZONE z AS t FROM s0),
ses AS MATERIALIZED (SELECT owner, CAST(CASE WHEN hour(t) >= 18 THEN CAST(t AS DATE) + 1 ELSE CAST(t AS DATE) END AS DATE) AS night, id, source, lo, hi, k,
  CASE WHEN id % 11 <> 0 THEN k * 48 END AS asleep, CASE WHEN id % 13 <> 0 THEN k * 6 END AS awake, CASE WHEN id % 5 <> 0 THEN k * 24 END AS light, CASE WHEN id % 6 <> 0 THEN k * 12 END AS deep, k * 12 AS rem,
  CASE WHEN id % 3 = 0 THEN k * 2 WHEN id % 4 <> 0 THEN k * 6 END AS latency, CASE WHEN id % 4 <> 0 THEN k * 3 END AS waso,
  CASE WHEN id % 4 <> 0 THEN 0 WHEN id % 5 <> 0 AND id % 6 <> 0 THEN CASE WHEN id % 11 <> 0 THEN greatest(k * 48 - k * 48, 0) END END AS unspecified FROM s1),
fr AS MATERIALIZED (SELECT *, max(hi) OVER (PARTITION BY owner, night, source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ses),
fi AS MATERIALIZED (SELECT *, sum(CASE WHEN reach IS NULL OR lo - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY owner, night, source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM fr),
fg AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY owner, night, source, isl) AS part FROM fi),
pt AS MATERIALIZED (SELECT owner, night, source, part, min(lo) AS lo, max(hi) AS hi, count(*) AS pieces, bool_and(k < 20) AS is_nap, bool_and(id % 4 <> 0) AS has_stages FROM fg GROUP BY ALL)"""

# every part takes the least label of what it overlaps by half of the shorter, in rounds until nothing changes (at most as many as the longest chain of a night)
_EPISODES = _SESSIONS + """,
lk AS MATERIALIZED (SELECT a.part AS u, b.part AS v FROM pt a JOIN pt b ON a.owner = b.owner AND a.night = b.night AND a.part <> b.part AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * least(a.hi - a.lo, b.hi - b.lo)),
rc(part, root) AS (SELECT part, part FROM pt UNION SELECT lk.v, min(rc.root) FROM rc JOIN lk ON lk.u = rc.part WHERE rc.root < lk.v GROUP BY lk.v),
rt AS MATERIALIZED (SELECT part, min(root) AS episode FROM rc GROUP BY part),
ep AS (SELECT owner, night, episode, min(lo) AS start, max(hi) AS "end" FROM pt JOIN rt USING (part) GROUP BY ALL),
em AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner, night ORDER BY start - "end", start, episode) = 1 AS main FROM ep)"""


@query("ev1_merged_sessions", _SESSIONS + " SELECT owner, night, source, part AS id, lo, hi, is_nap, has_stages, pieces FROM pt")
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sleep.parts(sleep.merged(sessions(spark, sf_dir), KEYS), KEYS)


@query("jn12_ev2_overlaps", _SESSIONS + """ SELECT a.part AS a, b.part AS b, round((least(a.hi, b.hi) - greatest(a.lo, b.lo)) / CAST(least(a.hi - a.lo, b.hi - b.lo) AS DOUBLE), 6) AS ratio
FROM pt a JOIN pt b ON a.owner = b.owner AND a.night = b.night AND (a.lo, a.part) < (b.lo, b.part) AND (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / CAST(least(a.hi - a.lo, b.hi - b.lo) AS DOUBLE) >= 0.25""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = episodes.links(sleep.parts(sleep.merged(sessions(spark, sf_dir), KEYS), KEYS).select(*KEYS, "id", "lo", "hi"), KEYS, 0.25)
    return found.select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("ev3_wn5_episodes", _EPISODES + """ SELECT owner, night, episode, start, "end", main, strftime(make_timestamp(start), '%Y-%m-%dT%H:%M:%SZ') AS window_key FROM em""")
def sleep_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window for each aligned episode; the longest of a night is the main one."""
    from strandline.functions.scalars import window_key

    _, spans = sleep.aligned(sessions(spark, sf_dir), KEYS)
    return spans.withColumn("window_key", window_key(F.timestamp_micros("start")))


_CAPTURES = _EPISODES + """,
mb AS MATERIALIZED (SELECT fg.*, episode, start, "end", main, CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 END AS pos FROM fg JOIN rt USING (part) JOIN em USING (owner, night, episode)),
un AS MATERIALIZED (SELECT *, greatest(least(hi, "end") - greatest(lo, coalesce(max(hi) OVER (PARTITION BY owner, night, episode, source ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)), 0) AS new FROM mb WHERE pos IS NOT NULL),
cv AS MATERIALIZED (SELECT owner, night, episode, pos, source, sum(new) / CAST(any_value("end" - start) AS DOUBLE) AS coverage, min((lo, id)) AS first_, min(lo) AS starts, max(hi) AS ends FROM un GROUP BY ALL),
cp AS MATERIALIZED (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY owner, night, episode, pos ORDER BY coverage DESC, first_) = 1)"""


def _captured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "sleep")
    rows, spans = (scratch.save(x) for x in sleep.aligned(scratch.save(sessions(spark, sf_dir)), KEYS))
    return rows, spans, sleep.captures(rows, spans, KEYS, assign.position(RULE, EXCLUDE), 0.4)


@query("ev4_captures", _CAPTURES + """ SELECT owner, night, episode, CAST(pos AS INTEGER) AS pos, source, round(coverage, 6) AS coverage, CASE WHEN coverage < 0.4 THEN 'partial_episode' END AS reason FROM cp""")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir)[2].withColumn("coverage", F.round("coverage", 6)).drop("first", "last")


_PLAIN = ("total", "in_bed", "awake", "light", "deep", "rem", "unspecified", "waso")
_OF = {"total": "asleep", "in_bed": "(hi - lo) / 1e6"}
_VALUES = _CAPTURES + """,
vl AS (SELECT un.owner, un.night, un.episode, un.pos, """ + ", ".join(f"CASE WHEN count({_OF.get(c, c)}) = count(*) THEN sum({_OF.get(c, c)}) END AS sleep_{c}" for c in _PLAIN) + """, first(latency ORDER BY lo, id) AS sleep_latency
  FROM un JOIN cp ON cp.owner = un.owner AND cp.night = un.night AND cp.episode = un.episode AND cp.source = un.source GROUP BY ALL),
ve AS MATERIALIZED (SELECT *, CASE WHEN sleep_in_bed > 0 THEN 100.0 * sleep_total / sleep_in_bed END AS sleep_efficiency FROM vl JOIN (SELECT owner, night, episode, pos, starts, ends, CASE WHEN coverage < 0.4 THEN 'partial_episode' END AS reason FROM cp) USING (owner, night, episode, pos))"""


def _valued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, spans, captured = _captured(spark, sf_dir)
    return spans, sleep.values(rows, captured, KEYS)


@query("ag8_sleep_values", _VALUES + " SELECT owner, night, episode, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in sleep.CODES) + " FROM ve")
def sleep_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valued(spark, sf_dir)[1].select(*KEYS, "episode", "pos", *[F.round(c, 4).alias(c) for c in sleep.CODES])


_SHOWN = ("sleep_total", "sleep_deep", "sleep_efficiency")


def _shown(df: DataFrame) -> list:
    return [F.round(F.element_at("components", c), 4).alias(c) for c in _SHOWN] + [F.element_at("missing", "sleep_deep").alias("deep_missing"), F.element_at("missing", "sleep_total").alias("total_missing")]


_PICK = _VALUES + """, pk AS (SELECT * FROM ve WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY owner, night, episode ORDER BY pos) = 1)"""
_CODES_SQL = ", ".join(f"round(CAST(p.{c} AS DOUBLE), 4) AS {c}" for c in _SHOWN) + """, CASE WHEN p.pos IS NOT NULL AND p.sleep_deep IS NULL THEN 'no_stage_data' END AS deep_missing, CASE WHEN p.pos IS NOT NULL AND p.sleep_total IS NULL THEN 'no_data' END AS total_missing"""


@query("ev5_ev9_resolved_sleep", _PICK + f""" SELECT e.owner, e.night, e.episode, e.start, e."end", e.main, CAST(p.pos AS INTEGER) AS selected, CASE WHEN p.pos IS NULL THEN 'no_data' WHEN p.pos = 0 THEN 'direct' ELSE 'fallback' END AS status, CASE WHEN p.pos > 0 THEN 1 ELSE 0 END AS warnings, {_CODES_SQL}
FROM em e LEFT JOIN pk p ON p.owner = e.owner AND p.night = e.night AND p.episode = e.episode""")
def resolved_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved nights: of every episode all codes from the group that the rule selects, with what it lacks; episodes of other sources alone have no data."""
    spans, valued = _valued(spark, sf_dir)
    got = sleep.select(valued, spans, KEYS).join(spans, [*KEYS, "episode"])
    return got.select(*KEYS, "episode", "start", "end", "main", "selected", "status", F.size("warnings").alias("warnings"), *_shown(got))


@query("ev5_timed_sleep", _VALUES + """, lt AS (SELECT * FROM ve WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY owner, night, episode ORDER BY ends DESC, pos) = 1), et AS (SELECT * FROM ve WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY owner, night, episode ORDER BY starts, pos) = 1),
o AS (SELECT 'latest' AS op, * FROM lt UNION ALL SELECT 'earliest', * FROM et), x AS (SELECT em.*, unnest(['latest', 'earliest']) AS op FROM em)
SELECT x.op, x.owner, x.night, x.episode, CAST(o.pos AS INTEGER) AS selected, CASE WHEN o.pos IS NULL THEN 'no_data' ELSE 'direct' END AS status, round(CAST(o.sleep_total AS DOUBLE), 4) AS sleep_total FROM x LEFT JOIN o ON o.op = x.op AND o.owner = x.owner AND o.night = x.night AND o.episode = x.episode""")
def timed_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by the group whose sessions end latest, and by the one whose sessions start earliest."""
    spans, valued = _valued(spark, sf_dir)
    valued = Scratch(spark, "timed").save(valued)
    one = lambda op: sleep.select(valued, spans, KEYS, op=op).select(F.lit(op).alias("op"), *KEYS, "episode", "selected", "status", F.round(F.element_at("components", "sleep_total"), 4).alias("sleep_total"))
    return one("latest").union(one("earliest"))


@query("ev6_forced_group", _PICK + f""", fc AS (SELECT * FROM ve WHERE pos = 1 AND owner % 2 = 0), p0 AS (SELECT owner, night, episode, pos, {', '.join(_SHOWN)} FROM pk WHERE (owner, night, episode) NOT IN (SELECT (owner, night, episode) FROM fc) UNION ALL SELECT owner, night, episode, pos, {', '.join(_SHOWN)} FROM fc)
SELECT e.owner, e.night, e.episode, CAST(p.pos AS INTEGER) AS selected, CASE WHEN p.pos IS NULL THEN 'no_data' WHEN p.pos = 1 AND e.owner % 2 = 0 THEN 'overridden' WHEN p.pos = 0 THEN 'direct' ELSE 'fallback' END AS status, {_CODES_SQL}
FROM em e LEFT JOIN p0 p ON p.owner = e.owner AND p.night = e.night AND p.episode = e.episode""")
def forced_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group forced by hand counts wherever it captured an episode, partial captures included; the other episodes are listed as without it."""
    spans, valued = _valued(spark, sf_dir)
    forced = spans.where("owner % 2 = 0").select(*KEYS).distinct().withColumn("pos", F.lit(1))
    got = sleep.select(valued, spans, KEYS, forced)
    return got.select(*KEYS, "episode", "selected", "status", *_shown(got))


@query("ev5_pooled_sleep", _VALUES + " SELECT em.owner, em.night, em.episode, " + ", ".join(f"round(avg({c}) FILTER (reason IS NULL), 4) AS {c}" for c in sleep.CODES) + " FROM em LEFT JOIN ve USING (owner, night, episode) GROUP BY em.owner, em.night, em.episode")
def pooled_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, valued = _valued(spark, sf_dir)
    return sleep.pooled(valued, spans, KEYS, "mean").select(*KEYS, "episode", *[F.round(c, 4).alias(c) for c in sleep.CODES])


@query("ag32_sleep_sources", _EPISODES + """ SELECT ses.owner, ses.night, episode, source, CASE source WHEN 'error' THEN 'excluded' WHEN 'signup' THEN 'not_in_rule' ELSE 'grouped' END AS rule_status, count(*) AS sessions, round(sum(hi - lo) / 1e6, 3) AS in_bed, CAST(sum(asleep) AS BIGINT) AS asleep
FROM ses JOIN em USING (owner, night) WHERE hi > start AND lo < "end" GROUP BY ALL""")
def sleep_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    _, spans = sleep.aligned(s, KEYS)
    got = sleep.all_sources(s, spans, KEYS, assign.membership(assign.position(RULE, EXCLUDE)))
    return got.withColumn("in_bed", F.round("in_bed", 3))


@query("ev7_ev8_workouts")
def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workouts by falling overlap, with one specific kind in a cluster, and the one that is shown of each; its alternates are counted, and what the rule excludes or doesn't match is never shown.

    What a link does depends on all better ones, which SQL can't express; a test takes them one by one.
    """
    rows = sessions(spark, sf_dir).select("owner", "id", "source", "lo", "hi").withColumn("sport", F.when(F.col("source") != "view", F.col("source"))).withColumn("place", F.when(F.col("source") == "view", 1).when(F.col("source") == "error", -1).when(F.col("source") != "signup", 0))
    found = episodes.best_first_clusters(rows, ["owner"], 0.6, "sport")
    ends = found.groupBy("owner", "cluster").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    return episodes.pick(found, ["owner", "cluster"], "place").select("owner", "cluster", "id", "lo", "hi", "sport", "alternates").join(ends, ["owner", "cluster"])
