"""Values within one group of sources and one window; every bucket of five minutes weighs the same.

All functions take rows with the window's key columns, ``pos`` (the group), ``source`` and instants,
and aggregate before each shuffle: a dense source shrinks to its buckets first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
BASE = 300 * MICROS


def micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def bucket_of(c: str | Column, size: int = BASE) -> Column:
    """Number of the bucket, counted from the epoch, that an instant is in."""
    return F.floor(micros(c) / F.lit(size)).cast("long")


def combine(how: str, c: str) -> Column:
    return {"mean": F.avg, "max": F.max, "sum": F.sum, "min": F.min}[how](c)


def buckets(df: DataFrame, keys: list[str], intra: str = "mean", size: int = BASE) -> DataFrame:
    """``(keys, b, m, n, low, high)``: the mean of each source per bucket, combined over the sources."""
    each = df.groupBy(*keys, "source", bucket_of("start_at", size).alias("b")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return each.groupBy(*keys, "b").agg(combine(intra, "mean").alias("m"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def intensive(df: DataFrame, keys: list[str], intra: str = "mean", size: int = BASE) -> DataFrame:
    """``(keys, value, buckets, count, min, max)``: the mean of the bucket means."""
    return buckets(df, keys, intra, size).groupBy(*keys).agg(F.avg("m").alias("value"), F.count("*").alias("buckets"), F.sum("n").alias("count"), F.min("low").alias("min"), F.max("high").alias("max"))


def parts(df: DataFrame, size: int, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Rows split over buckets, with ``b`` and the linear ``part`` of the value; a row that ends at or before its start is an instant.

    ``lo``, ``hi``: microseconds that the row is clipped to.
    """
    s, e = micros("start_at"), micros("end_at")
    df = df.withColumn("_s", s).withColumn("_e", F.greatest(e, s)).withColumn("_lo", F.greatest("_s", lo) if lo is not None else F.col("_s")).withColumn("_hi", F.least("_e", hi) if hi is not None else F.col("_e"))
    instant = F.col("_e") == F.col("_s")
    df = df.where(instant | (F.col("_lo") < F.col("_hi")))
    first = F.expr(f"floor(_lo / {size}D)")
    last = F.when(instant, first).otherwise(F.expr(f"floor((_hi - 1) / {size}D)"))
    df = df.withColumn("b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    span = F.least("_hi", (F.col("b") + 1) * size) - F.greatest("_lo", F.col("b") * size)
    part = F.when(F.col("_e") == F.col("_s"), F.col("value")).otherwise(F.col("value") * span / (F.col("_e") - F.col("_s")))
    return df.withColumn("part", part).drop("_s", "_e", "_lo", "_hi")


def additive(df: DataFrame, keys: list[str], intra: str = "max", size: int = BASE) -> DataFrame:
    """``(keys, value, buckets)``: intervals spread over buckets, summed per source, combined per bucket, summed."""
    # one shuffle of the rows, before they are cut, serves the three aggregations
    rows = df.select(*keys, "source", "start_at", "end_at", "value").repartition(*keys)
    each = parts(rows, size).groupBy(*keys, "source", "b").agg(F.sum("part").alias("v"))
    return each.groupBy(*keys, "b").agg(combine(intra, "v").alias("v")).groupBy(*keys).agg(F.sum("v").alias("value"), F.count("*").alias("buckets"))


def daily(df: DataFrame, keys: list[str], intra: str = "max") -> DataFrame:
    """``(keys, value)``: the latest value of each source, combined."""
    each = df.groupBy(*keys, "source").agg(F.max_by("value", F.struct("start_at", "id")).alias("v"))
    return each.groupBy(*keys).agg(combine(intra, "v").alias("value"))


def prefer_reported(reported: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, value, basis)``: a reported daily value wins over the sum of intervals; the two are never added."""
    a, b = reported.select(*keys, F.col("value").alias("_r")), counted.select(*keys, F.col("value").alias("_c"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_r", "_c").alias("value"), F.when(F.col("_r").isNotNull(), "daily_value").otherwise("intervals").alias("basis"))


def daily_summary(df: DataFrame, keys: list[str], is_daily: Column) -> DataFrame:
    """``(keys, value)``: the latest daily value, else the latest sample."""
    return df.withColumn("_d", is_daily).groupBy(*keys).agg(F.max_by("value", F.struct("_d", "start_at", "id")).alias("value"))


def latest(df: DataFrame, keys: list[str], as_of: Column | None = None) -> DataFrame:
    """``(keys, value, at, id)``: the latest row at or before an instant."""
    df = df if as_of is None else df.where(F.col("start_at") <= as_of)
    return df.groupBy(*keys).agg(F.max_by(F.struct("value", "start_at", "id"), F.struct("start_at", "id")).alias("r")).select(*keys, "r.value", F.col("r.start_at").alias("at"), "r.id")


def latest_reading(df: DataFrame, keys: list[str], reading: str, code: str) -> DataFrame:
    """``(keys, reading, components)``: the latest reading with all its components together, as a map."""
    whole = df.groupBy(*keys, reading).agg(F.max("start_at").alias("at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "value")))).alias("components"))
    return whole.groupBy(*keys).agg(F.max_by(F.struct(reading, "components"), F.struct("at", reading)).alias("r")).select(*keys, "r.*")


def lowest_bucket(df: DataFrame, keys: list[str], size: int = BASE) -> DataFrame:
    """``(keys, value, b)``: the lowest bucket mean, the earliest of equals."""
    return buckets(df, keys, size=size).groupBy(*keys).agg(F.min(F.struct("m", "b")).alias("r")).select(*keys, F.col("r.m").alias("value"), F.col("r.b").alias("b"))


def lowest_rolling_mean(df: DataFrame, keys: list[str], n: int, size: int = BASE, noise: float = 1e-9) -> DataFrame:
    """``(keys, value, b)``: the lowest mean over ``n`` buckets in a row, all covered; a later span must be lower by more than ``noise``."""
    w = Window.partitionBy(*keys).orderBy("b")
    span = w.rowsBetween(1 - n, 0)
    full = F.col("b") - F.first("b").over(span) == n - 1
    rolled = buckets(df, keys, size=size).withColumn("v", F.sum("m").over(span) / n).withColumn("ok", full & (F.count("*").over(span) == n)).where("ok")
    # spans come in order, so that the first of those as low as any stays
    best = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("b").alias("b"), F.col("v").alias("v")))),
        F.struct(F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("v")),
        lambda a, x: F.when(a["b"].isNull() | (x["v"] < a["v"] - noise), F.struct(x["b"].alias("b"), x["v"].alias("v"))).otherwise(a),
    )
    return rolled.groupBy(*keys).agg(best.alias("r")).select(*keys, F.col("r.v").alias("value"), (F.col("r.b") - n + 1).alias("b"))


def worn(df: DataFrame, wear: DataFrame, keys: list[str], size: int = BASE) -> DataFrame:
    """``df`` with ``state`` per row: ``counted``, ``not_worn``, or ``exempt`` for sources that never report wear.

    ``wear(keys, source, b)`` holds the buckets in which a source was worn; a source with any row there reports wear.
    """
    buckets_worn = wear.select(*keys, "source", "b").distinct().withColumn("_w", F.lit(True))
    reports = wear.select(*keys, "source").distinct().withColumn("_r", F.lit(True))
    df = df.withColumn("b", bucket_of("start_at", size)).join(reports, [*keys, "source"], "left").join(buckets_worn, [*keys, "source", "b"], "left")
    state = F.when(F.col("_r").isNull(), "exempt").when(F.col("_w"), "counted").otherwise("not_worn")
    return df.withColumn("state", state).drop("_w", "_r")


def coverage(covered: Column, seconds: Column, size: int = BASE) -> Column:
    """Share of the buckets of a window that are covered, 1 at most."""
    return F.least(F.lit(1.0), covered / F.ceil(seconds * MICROS / F.lit(size)))


def contributions(df: DataFrame, keys: list[str], start: str, end: str, now: Column, size: int = BASE) -> DataFrame:
    """``(keys, count, refs, sources, first, last, covered, elapsed, coverage)`` of the rows of a group in a window.

    Instants are microseconds.  Buckets are counted from the window's start, cut to whole ones, up to its
    end or now; ``sources`` come in the order of their first rows.
    """
    s = micros("start_at")
    stop = F.least(F.col(end), now)
    first = F.expr(f"`{start}` - pmod(`{start}`, {size})")
    b = F.expr(f"unix_micros(start_at) div {size}")
    rows = df.withColumn("_b", F.when((s >= first) & (b * size < stop), b)).withColumn("_n", F.when(stop > F.col(start), F.ceil((stop - first) / F.lit(size))).otherwise(0))
    # one row for each source and bucket, then one for each source
    each = rows.groupBy(*keys, "source", "_b").agg(F.count("*").alias("_k"), F.sort_array(F.collect_list("id")).alias("_ids"), F.min(F.struct(s.alias("t"), F.col("id"))).alias("_f"), F.max(s).alias("_l"), F.max("_n").alias("_n"))
    total = each.groupBy(*keys).agg(
        F.sum("_k").alias("count"), F.array_sort(F.flatten(F.collect_list("_ids"))).alias("refs"), F.array_sort(F.collect_set(F.struct("_f", "source"))).alias("_s"),
        F.min("_f.t").alias("first"), F.max("_l").alias("last"), F.count_distinct("_b").alias("covered"), F.max("_n").alias("elapsed"),
    )
    share = F.when(F.col("elapsed") > 0, F.least(F.lit(1.0), F.col("covered") / F.col("elapsed"))).otherwise(0.0)
    return total.select(*keys, "count", "refs", F.array_distinct(F.transform("_s", lambda x: x["source"])).alias("sources"), "first", "last", "covered", "elapsed", share.alias("coverage"))


def coverage_gated(basis: Column, agg: Column, requires_wear: Column, exempt: Column) -> Column:
    """Whether the coverage gate applies: to values of bucket means, and to additive ones that the wear gate covers."""
    return basis.isin("bucket_means", "min_rolling_mean", "min") | ((agg == "additive") & requires_wear & ~exempt)


def worn_additive(values: DataFrame, wear: DataFrame, keys: list[str], elapsed: Column) -> DataFrame:
    """``values(keys, value, gated)`` under the wear gate: ``worn`` buckets, ``coverage``, ``status`` and ``reason``.

    ``wear(keys, worn)`` counts the buckets in which a device of the group was worn; a group without a row
    there reports no wear and is exempt.  Worn without rows is a measured 0; rows in unworn buckets only
    (``gated`` counts them) leave a group that was not worn.
    """
    df = values.join(wear, keys, "full").withColumn("exempt", F.col("worn").isNull())
    has, gone = F.col("value").isNotNull(), F.coalesce("gated", F.lit(0)) > 0
    status = F.when(F.col("exempt"), F.when(has, "valid").otherwise("no_data")).when((F.col("worn") == 0) & (has | gone), "below_quality").when(F.col("worn") == 0, "no_data").otherwise("valid")
    df = df.withColumn("status", status).withColumn("reason", F.when((status == "below_quality"), "not_worn"))
    zero = (F.col("status") == "valid") & ~has
    return df.withColumn("coverage", F.when(~F.col("exempt") & (F.col("worn") > 0), F.least(F.lit(1.0), F.col("worn") / elapsed))).withColumn("value", F.when(zero, F.lit(0.0)).when(F.col("status") == "valid", F.col("value")))


def mean_of_readings(df: DataFrame, keys: list[str], reading: str, code: str) -> DataFrame:
    """``(keys, code, value, readings)``: mean of each component over the readings of a window, every reading weighing the same."""
    each = df.groupBy(*keys, code, reading).agg(F.avg("value").alias("v"))
    return each.groupBy(*keys, code).agg(F.avg("v").alias("value"), F.count("*").alias("readings"))


def aggregate(df: DataFrame, keys: list[str], agg: str = "agg", kind: str = "kind") -> DataFrame:
    """``(keys, value, basis)`` of rows of many metrics at once, each by the step that its class ``agg`` asks for.

    Intensive metrics are means of bucket means of their samples, additive ones a reported daily value or
    else the sum of intervals, daily summaries the latest daily value or else the latest sample, and the
    others the latest row.  Rows carry ``kind``: sample, interval or daily_value.
    """
    of = lambda name: df.where(F.col(agg) == name)
    daily_ = F.col(kind) == "daily_value"
    means = intensive(of("intensive").where(~daily_), keys).select(*keys, "value", F.lit("bucket_means").alias("basis"))
    sums = prefer_reported(daily(of("additive").where(daily_), keys), additive(of("additive").where(~daily_), keys), keys)
    summary = of("daily_summary").withColumn("_d", daily_).groupBy(*keys).agg(F.max_by(F.struct("value", "_d"), F.struct("_d", "start_at", "id")).alias("r"))
    summary = summary.select(*keys, "r.value", F.when(F.col("r._d"), "daily_value").otherwise("latest").alias("basis"))
    last = latest(of("latest"), keys).select(*keys, "value", F.lit("latest").alias("basis"))
    return means.union(sums.select(*keys, "value", "basis")).union(summary).union(last)
