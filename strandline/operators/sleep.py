"""Sleep: sessions of one source merged, aligned over sources to episodes, captured by groups, and read as codes.

Sessions have the window's ``keys`` (owner and night), ``id``, ``source``, ``lo`` and ``hi`` in microseconds,
``is_nap``, ``has_stages``, totals in seconds that may be null (``asleep``, ``awake``, ``light``, ``deep``, ``rem``,
``latency``), and ``stages array<struct<stage,lo,hi>>``.  A total that is missing is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.episodes import clusters, islands

GAP = 3_600_000_000
# Stages that are sleep, and codes that need stages.
ASLEEP = ("light", "deep", "rem", "asleep_unspecified")
CODES = ("sleep_total", "sleep_in_bed", "sleep_awake", "sleep_light", "sleep_deep", "sleep_rem", "sleep_latency", "sleep_unspecified", "sleep_waso", "sleep_efficiency")
STAGED = ("sleep_awake", "sleep_light", "sleep_deep", "sleep_rem", "sleep_unspecified", "sleep_waso")


def merged(sessions: DataFrame, keys: list[str], gap: int = GAP) -> DataFrame:
    """``sessions`` with ``part``, the least id of the sessions of one source that no more than ``gap`` divides."""
    cut = islands(sessions, [*keys, "source"], "lo", "hi", gap)
    return cut.withColumn("part", F.min("id").over(Window.partitionBy(*keys, "source", "island"))).drop("island")


def parts(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, source, id, lo, hi, is_nap, has_stages, pieces)`` of merged sessions; naps and stages count if all pieces have them."""
    return sessions.groupBy(*keys, "source", F.col("part").alias("id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and("is_nap").alias("is_nap"), F.bool_and("has_stages").alias("has_stages"), F.count("*").alias("pieces"))


def aligned(sessions: DataFrame, keys: list[str], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Merged sessions with their ``episode``, and ``(keys, episode, start, end, main)``: the longest one of a night is main, the first of equals."""
    held = merged(sessions, keys)
    whole = clusters(parts(held, keys), keys, least, "sleep").withColumnRenamed("cluster", "episode")
    spans = whole.groupBy(*keys, "episode").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("start") - F.col("end"), "start", "episode")) == 1
    rows = held.join(whole.select(*keys, F.col("id").alias("part"), "episode"), [*keys, "part"])
    return rows, spans.withColumn("main", first)


def captures(rows: DataFrame, spans: DataFrame, keys: list[str], pos: Column, least_coverage: float = 0.0) -> DataFrame:
    """``(keys, episode, pos, source, coverage, first, last, reason)``: for each group the one of its sources that covers most of an episode, with the ends of its sessions.

    Sources of a group are never added up.  Coverage is the union of a source's sessions over the span
    of the episode; under ``least_coverage`` the group is ``partial_episode``.
    """
    own = rows.withColumn("pos", pos).where("pos >= 0").join(spans, [*keys, "episode"])
    where = [*keys, "episode", "pos", "source"]
    reach = F.max("hi").over(Window.partitionBy(*where).orderBy("lo", "hi", "id").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.least("hi", "end") - F.greatest("lo", F.coalesce(reach, "start")), F.lit(0))
    held = own.withColumn("_new", new).groupBy(*where).agg((F.sum("_new") / F.max(F.col("end") - F.col("start"))).alias("coverage"), F.min(F.struct("lo", "id")).alias("_first"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    best = held.groupBy(*keys, "episode", "pos").agg(F.min_by(F.struct("source", "coverage", "first", "last"), F.struct(-F.col("coverage"), "_first")).alias("r"))
    return best.select(*keys, "episode", "pos", "r.*").withColumn("reason", F.when(F.col("coverage") < least_coverage, "partial_episode"))


def _first_asleep() -> Column:
    return F.array_min(F.transform(F.filter("stages", lambda s: s["stage"].isin(*ASLEEP)), lambda s: s["lo"]))


def _last_asleep() -> Column:
    return F.array_max(F.transform(F.filter("stages", lambda s: s["stage"].isin(*ASLEEP)), lambda s: s["hi"]))


def _sum(items: Column, length) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, s: a + length(s) / 1e6)


def session_values() -> dict[str, Column]:
    """Codes of one session in seconds, null where it lacks them."""
    first, last = _first_asleep(), _last_asleep()
    awake = _sum(F.filter("stages", lambda s: s["stage"] == "awake"), lambda s: F.greatest(F.least(s["hi"], last) - F.greatest(s["lo"], first), F.lit(0)))
    rest = F.greatest(F.col("asleep") - sum((F.coalesce(c, F.lit(0)) for c in ("deep", "light", "rem")), F.lit(0)), F.lit(0))
    staged = F.col("has_stages") | (F.col("deep").isNotNull() & F.col("light").isNotNull() & F.col("rem").isNotNull())
    unspecified = F.when(F.size("stages") > 0, _sum(F.filter("stages", lambda s: s["stage"] == "asleep_unspecified"), lambda s: s["hi"] - s["lo"])).when(staged & F.col("asleep").isNotNull(), rest)
    out = {
        "sleep_total": F.col("asleep"), "sleep_in_bed": (F.col("hi") - F.col("lo")) / 1e6, "sleep_awake": F.col("awake"), "sleep_light": F.col("light"), "sleep_deep": F.col("deep"), "sleep_rem": F.col("rem"),
        "sleep_latency": F.coalesce("latency", F.when(first.isNotNull(), F.greatest(first - F.col("lo"), F.lit(0)) / 1e6)), "sleep_unspecified": unspecified, "sleep_waso": F.when(first.isNotNull(), awake),
    }
    return {k: c.cast("double") for k, c in out.items()}


def values(rows: DataFrame, captured: DataFrame, keys: list[str]) -> DataFrame:
    """``captured`` with a column for each of ``CODES``: sums over the sessions, the first one's latency; one session that lacks a code makes it missing."""
    own = rows.withColumns(session_values()).join(captured.select(*keys, "episode", "pos", "source"), [*keys, "episode", "source"])
    summed = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in CODES if c not in ("sleep_latency", "sleep_efficiency")]
    first = F.min_by(F.struct("sleep_latency"), F.struct("lo", "id"))["sleep_latency"].alias("sleep_latency")
    out = own.groupBy(*keys, "episode", "pos").agg(*summed, first)
    out = out.withColumn("sleep_efficiency", F.when(F.col("sleep_in_bed") > 0, 100 * F.col("sleep_total") / F.col("sleep_in_bed")))
    return captured.join(out.select(*keys, "episode", "pos", *CODES), [*keys, "episode", "pos"])


def _read(r: Column) -> list[Column]:
    """Components and what is missing, from one group's struct."""
    have = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in CODES]), F.array(*[r[c] for c in CODES])), lambda k, v: v.isNotNull())
    lack = F.filter(F.array(*[F.lit(c) for c in CODES]), lambda c: ~F.map_contains_key(have, c))
    state = lambda c: F.when(c.isin(*STAGED), "no_stage_data").otherwise("no_data")
    return [have.alias("components"), F.map_from_arrays(lack, F.transform(lack, state)).alias("missing")]


def select(valued: DataFrame, spans: DataFrame, keys: list[str], forced: DataFrame | None = None, op: str = "first_available") -> DataFrame:
    """``(keys, episode, selected, status, warnings, components, missing)`` of every episode of ``spans``: all codes from the group that the rule selects.

    The first valid group; or, as ``op`` says, the one whose sessions end latest or start earliest, ties staying with
    the earlier group.  An episode that no group of the rule captured, or none well enough, is listed with
    ``no_data``.  A code that the selected group lacks is missing, never taken from another group.
    ``forced(keys, pos)`` names a group that counts wherever it captured the episode, whatever its coverage.
    """
    df = valued.withColumn("_f", F.lit(None).cast("int")) if forced is None else valued.join(forced.select(*keys, F.col("pos").alias("_f")), keys, "left")
    best = F.struct("pos", *CODES)
    ok = F.col("reason").isNull()
    order = {"latest": F.struct(-F.col("last"), "pos"), "earliest": F.struct("first", "pos")}.get(op, F.struct("pos"))
    picked = df.groupBy(*keys, "episode").agg(F.min_by(best, F.when(ok, order)).alias("r"), F.max(F.when(F.col("pos") == F.col("_f"), best)).alias("f"))
    picked = spans.select(*keys, "episode").join(picked, [*keys, "episode"], "left").withColumn("s", F.coalesce("f", "r"))
    timed = F.lit(op in ("latest", "earliest"))
    status = F.when(F.col("f").isNotNull(), "overridden").when(F.col("s").isNull(), "no_data").when(timed | (F.col("s.pos") == 0), "direct").otherwise("fallback")
    warned = F.when(status == "fallback", F.array(F.lit("preferred_source_unavailable"))).otherwise(F.array().cast("array<string>"))
    return picked.select(*keys, "episode", F.col("s.pos").alias("selected"), status.alias("status"), warned.alias("warnings"), *[F.when(F.col("s").isNotNull(), c).alias(n) for c, n in zip(_read(F.col("s")), ("components", "missing"), strict=True)])


def pooled(valued: DataFrame, spans: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``(keys, episode, <codes>)`` of every episode: each code over the valid groups that have it; null where none has."""
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    ok = F.col("reason").isNull()
    own = valued.groupBy(*keys, "episode").agg(*[fn(F.when(ok, F.col(c))).alias(c) for c in CODES])
    return spans.select(*keys, "episode").join(own, [*keys, "episode"], "left")


def all_sources(sessions: DataFrame, spans: DataFrame, keys: list[str], membership: Column) -> DataFrame:
    """``(keys, episode, source, rule_status, sessions, in_bed, asleep)``: every source with a session that overlaps an episode, inside the rule or not."""
    met = sessions.join(spans.select(*keys, "episode", "start", "end"), keys).where("hi > start and lo < end")
    return met.groupBy(*keys, "episode", "source", membership.alias("rule_status")).agg(F.count("*").alias("sessions"), (F.sum(F.col("hi") - F.col("lo")) / 1e6).alias("in_bed"), F.sum("asleep").alias("asleep"))
