"""Windows by the local wall clock, and rows put into them by equal keys instead of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import overlap, points_in_spans
from strandline.operators.within import micros


def day_bounds(days: DataFrame, date: str = "local_date", zone: str = "zone") -> DataFrame:
    """``days`` with ``day_start`` and ``day_end``, the instants of local midnight: 23 or 25 hours apart when clocks change."""
    at = lambda c: F.to_utc_timestamp(c.cast("timestamp_ntz").cast("timestamp"), F.col(zone))
    return days.withColumn("day_start", at(F.col(date))).withColumn("day_end", at(F.date_add(date, 1)))


def day_windows(days: DataFrame, minutes: int) -> DataFrame:
    """Windows of a length, counted from local midnight in absolute time; the last one ends at the next midnight."""
    size = minutes * 60_000_000
    out = days.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((micros("day_end") - micros("day_start") - 1) / F.lit(size)))))
    start = micros("day_start") + F.col("slot") * size
    return out.withColumn("start", F.timestamp_micros(start)).withColumn("end", F.timestamp_micros(F.least(start + size, micros("day_end"))))


def local_parts(rows: DataFrame, lo: str, hi: str, zone: str = "zone", size: int = 3_600_000_000) -> DataFrame:
    """``rows`` once for each local hour (window of ``size``) that their span [lo, hi) in microseconds reaches.

    Adds ``local_date``, ``hour_start`` and the part [``part_lo``, ``part_hi``) in it.  Windows are counted
    in absolute time from the owner's local midnight and the last one is cut at the next midnight, so
    that half-hour zones and days of 23 or 25 hours come out right.  A span of no length is an instant.
    """
    at = lambda c: F.from_utc_timestamp(F.timestamp_micros(c), F.col(zone))
    end = F.greatest(F.col(hi) - 1, F.col(lo))
    days = rows.withColumn("local_date", F.explode(F.sequence(F.to_date(at(F.col(lo))), F.to_date(at(end)))))
    days = day_bounds(days, zone=zone).withColumn("_d0", micros("day_start")).withColumn("_d1", micros("day_end"))
    days = days.withColumn("_lo", F.greatest(lo, "_d0")).withColumn("_hi", F.greatest(F.least(hi, "_d1"), "_lo"))
    slots = F.sequence(F.expr(f"(_lo - _d0) div {size}"), F.expr(f"(greatest(_hi - 1, _lo) - _d0) div {size}"))
    cut = days.withColumn("_slot", F.explode(slots)).withColumn("hour_start", F.col("_d0") + F.col("_slot") * size)
    cut = cut.withColumn("part_lo", F.greatest("_lo", "hour_start")).withColumn("part_hi", F.least("_hi", F.col("hour_start") + size))
    return cut.drop("day_start", "day_end", "_d0", "_d1", "_lo", "_hi", "_slot")


def slot_of(at: str, day_start: str, minutes: int) -> Column:
    """Number of the window of its day that an instant is in."""
    return F.floor((micros(at) - micros(day_start)) / F.lit(minutes * 60_000_000)).cast("long")


def periods(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Zones of an owner as intervals [lo, hi) in microseconds; the first one also covers all that came before."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    lo = F.when(F.row_number().over(w) == 1, F.lit(-(1 << 62))).otherwise(micros("valid_from"))
    return timeline.select(*keys, "zone", lo.alias("lo"), F.coalesce(F.lead(micros("valid_from")).over(w), F.lit(1 << 62)).alias("hi"))


def zone_at(rows: DataFrame, timeline: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` with the ``zone`` that held at an instant: the last period from before, else the first one."""
    p = periods(timeline, keys)
    return rows.join(p, keys, "left").where(F.col("lo").isNull() | ((micros(at) >= F.col("lo")) & (micros(at) < F.col("hi")))).drop("lo", "hi")


def changed_range(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, lo, hi)``: smallest interval per owner in which two timelines give different zones; none where they agree everywhere."""
    a, b = periods(old, keys), periods(new, keys)
    starts = a.select(*keys, "lo").union(b.select(*keys, "lo")).distinct()
    ends = F.coalesce(F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo")), F.lit(1 << 62))
    segments = starts.withColumn("_end", ends)
    for n, p in (("_a", a), ("_b", b)):
        p = p.select(*keys, F.col("zone").alias(n), F.col("lo").alias(f"{n}lo"), F.col("hi").alias(f"{n}hi"))
        segments = segments.join(p, keys, "left").where((F.col("lo") >= F.col(f"{n}lo")) & (F.col("lo") < F.col(f"{n}hi")))
    return segments.where("_a <> _b").groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("_end").alias("hi"))


def local_at(days: DataFrame, timeline: DataFrame, keys: list[str], out: str, date: str = "local_date", minutes: int = 0) -> DataFrame:
    """``days`` with ``out``, the instant of a local time of day in the zone that holds then.

    The zone is guessed from the wall time as if it were UTC; the zone at that guess's instant replaces
    it if it holds at its own instant too.
    """
    wall = F.timestamp_micros(micros(F.col(date).cast("timestamp")) + minutes * 60_000_000)
    at = lambda zone: F.to_utc_timestamp(F.col("_wall"), F.col(zone))
    df = days.withColumn("_wall", wall)
    df = zone_at(df, timeline, keys, "_wall").withColumnRenamed("zone", "_z1").withColumn("_t1", at("_z1"))
    df = zone_at(df, timeline, keys, "_t1").withColumnRenamed("zone", "_z2").withColumn("_t2", at("_z2"))
    df = zone_at(df, timeline, keys, "_t2").withColumnRenamed("zone", "_z3")
    return df.withColumn(out, F.when((F.col("_z1") != F.col("_z2")) & (F.col("_z2") == F.col("_z3")), F.col("_t2")).otherwise(F.col("_t1"))).drop("_wall", "_z1", "_z2", "_z3", "_t1", "_t2")


def rows_in(rows: DataFrame, spans: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """``rows(keys, kind, lo, hi, local_date)`` with the windows ``spans(keys, start, end, local_date, key)`` that hold them, by the rule of the window kind.

    A local day holds rows by their stored date, daily values among them.  The other spans hold samples
    by their instant and intervals that they overlap, and no daily values.
    """
    if kind == "local_day":
        return rows.join(spans, [*keys, "local_date"])
    r = rows.where("kind <> 'daily_value'").drop("local_date")
    instant = F.col("hi") <= F.col("lo")
    points = points_in_spans(r.where(instant), spans, keys, "lo", ("start", "end"))
    return points.unionByName(overlap(r.where(~instant), spans, keys, ("lo", "hi"), ("start", "end")))


def readings(rows: DataFrame, keys: list[str], group: str, id_col: str, at: str) -> DataFrame:
    """``(keys, key, start, n)``: one window for each reading; a row without a group is a reading of its own."""
    key = F.when(F.col(group).isNotNull(), F.concat(F.lit("g:"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("m:"), F.col(id_col).cast("string")))
    return rows.groupBy(*keys, key.alias("key")).agg(F.min(at).alias("start"), F.count("*").alias("n"))


def partial(end: Column, now: Column) -> Column:
    """Whether a window ends after now."""
    return end > now


# Window kinds that each class of metrics may be resolved by.
ALLOWED = {
    "intensive": ("bucket", "hour", "local_day", "local_night", "sleep_episode", "latest"), "additive": ("bucket", "hour", "local_day"), "latest": ("local_day", "latest"),
    "daily_summary": ("local_day", "latest"), "sleep_derived": ("local_night", "sleep_episode"),
}


def allowed(agg: Column, kind: str) -> Column:
    return agg.isin(*[a for a, kinds in ALLOWED.items() if kind in kinds])


def daily_kind(agg: Column, rule: Column) -> Column:
    """The kind with one window a date: the rule's own day or night, else the night for metrics that have no day."""
    return F.when(rule.isin("local_day", "local_night"), rule).when(~allowed(agg, "local_day"), "local_night").otherwise("local_day")


def drill_kind(agg: Column, rule: Column, by_date: Column) -> Column:
    """The kind that a window's key is looked up by: for a date the daily one, else the rule's buckets or episodes, else hours."""
    return F.when(by_date, daily_kind(agg, rule)).when(rule.isin("bucket", "sleep_episode"), rule).when(~allowed(agg, "hour"), "sleep_episode").otherwise("hour")


def recompute_dates(rows: DataFrame, timeline: DataFrame, keys: list[str], at: str, lo: Column, hi: Column) -> DataFrame:
    """Rows of [lo, hi) whose date came from the owner's timeline and changes under a new one, with ``new_date``."""
    t = micros(at)
    found = zone_at(rows.where("offset is null").where((t >= lo) & (t < hi)).drop("zone"), timeline, keys, at)
    return found.withColumn("new_date", F.to_date(F.from_utc_timestamp(at, F.col("zone")))).where(F.col("new_date") != F.col("local_date"))
