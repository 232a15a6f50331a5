"""Aggregates that dashboards read: hours, series, coverage, inventories, rollups and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import windows, within
from strandline.sources.tables import parts_of

HOUR = 3_600_000_000


def hourly(df: DataFrame, keys: list[str], interval: Column, zone: str = "zone", days: DataFrame | None = None) -> DataFrame:
    """``(keys, local_date, hour_start, samples, buckets, bucket_mean_sum, min_value, max_value, interval_sum, first_at, last_at)`` per source and local hour.

    ``interval`` tells rows that last from samples.  A sample counts in its hour, an interval in every
    hour that it overlaps, by its share; ``buckets`` counts the five-minute buckets with a sample or a
    part of an interval.  Hours are those of the owner's wall clock; instants are microseconds.
    ``days(keys, local_date)``: only the hours of these.
    Rows become parts in hours and are shuffled once, by the day, into as many tasks as there are rows for;
    a part tells the buckets that it reaches by bits, so that it stays one row.
    """
    s = F.unix_micros("start_at")
    lasts = interval & (F.col("end_at") > F.col("start_at"))
    rows = df.select(*keys, F.col(zone).alias("_zone"), "value", lasts.alias("_lasts"), s.alias("_s"), F.when(lasts, F.unix_micros("end_at")).otherwise(s).alias("_e"))
    day, n = [*keys, "local_date"], parts_of(df)
    cut = windows.local_parts(rows, "_s", "_e", "_zone", HOUR).drop("_zone").repartition(n, *day)
    if days is not None:
        cut = cut.join(days.select(*day).repartition(n, *day).hint("shuffle_hash"), day, "left_semi")
    hour, sample = [*day, "hour_start"], F.when(~F.col("_lasts"), F.col("value"))
    share = F.when(F.col("_lasts"), F.col("value") * (F.col("part_hi") - F.col("part_lo")) / (F.col("_e") - F.col("_s")))
    b, last = F.expr(f"part_lo div {within.BASE}"), F.expr(f"greatest(part_hi - 1, part_lo) div {within.BASE}")
    # an hour starts in a bucket and reaches into twelve more at most
    cut = cut.withColumn("b", b).withColumn("_n", (last - b + 1).cast("int")).withColumn("_i", (b - F.expr(f"hour_start div {within.BASE}")).cast("int"))
    each = cut.groupBy(*hour, "b").agg(
        F.count("*").alias("n"), F.avg(sample).alias("m"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(share).alias("part"),
        F.min("part_lo").alias("first"), F.max("part_hi").alias("last"), F.bit_or(F.expr("shiftleft(shiftleft(1L, _n) - 1L, _i)")).alias("_bits"),
    )
    return each.groupBy(*hour).agg(
        F.sum("n").alias("samples"), F.bit_count(F.bit_or("_bits")).cast("long").alias("buckets"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("bucket_mean_sum"), F.min("low").alias("min_value"),
        F.max("high").alias("max_value"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("interval_sum"), F.min("first").alias("first_at"), F.max("last").alias("last_at"),
    )


def series(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Means and sums over hourly rows, from the first of their hours on: the mean of all bucket means, not of hours."""
    return hours.groupBy(*keys).agg(F.min("hour_start").alias("hour_start"), (F.sum("bucket_mean_sum") / F.sum("buckets")).alias("mean"), F.min("min_value").alias("min"), F.max("max_value").alias("max"), F.sum("interval_sum").alias("sum"), F.sum("samples").alias("samples"))


def spacing(df: DataFrame, keys: list[str], bucket: int = 86_400_000_000, cell: int = 60_000_000) -> DataFrame:
    """``(keys, spacing)``: the median time between instants in microseconds, the upper one of two.

    Instants are put in order within buckets of time only, each knowing the last one of the buckets before;
    gaps are counted by their length, and only the cell of lengths that holds the median is ranked.
    """
    t = F.unix_micros("start_at")
    own = df.select(*keys, t.alias("_t"), F.floor(t / F.lit(bucket)).alias("_b"))
    ends = own.groupBy(*keys, "_b").agg(F.max("_t").alias("_end"))
    before = ends.withColumn("_far", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_end").withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_b": "_bb"})
    same = F.col("_b") == F.col("_bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    last = F.coalesce(F.lag("_t").over(Window.partitionBy(*keys, "_b").orderBy("_t")), F.col("_far"))
    gaps = own.join(before, same).withColumn("gap", F.col("_t") - last).where("gap is not null")
    held = gaps.groupBy(*keys, "gap").agg(F.count("*").alias("_n")).withColumn("_c", F.floor(F.col("gap") / F.lit(cell)))
    cells = held.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"))
    total = Window.partitionBy(*keys)
    cells = cells.withColumn("_to", F.sum("_n").over(total.orderBy("_c"))).withColumn("_all", F.sum("_n").over(total)).withColumn("_rank", F.floor(F.col("_all") / 2))
    cells = cells.where("_rank >= _to - _n and _rank < _to").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_c").alias("_cc"), (F.col("_to") - F.col("_n")).alias("_from"), "_rank")
    same = F.col("_c") == F.col("_cc")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = held.join(cells, same).withColumn("_to", F.col("_from") + F.sum("_n").over(Window.partitionBy(*keys, "_c").orderBy("gap")))
    return inner.where("_rank >= _to - _n and _rank < _to").select(*keys, F.col("gap").alias("spacing"))


def rollup(values: DataFrame, days: DataFrame, keys: list[str], additive: bool) -> DataFrame:
    """Counts and statistics of resolved daily values over all days of a range, days without a value included."""
    out = days.join(values, [*keys, "local_date"], "left").groupBy(*keys)
    extra = [F.sum("value").alias("sum")] if additive else []
    n = F.count("value")
    return out.agg(n.alias("n"), F.count("*").alias("days"), (n / F.count("*")).alias("coverage"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), *extra)


def compare_periods(values: DataFrame, keys: list[str], last: Column, lengths: tuple[int, ...], spark_days: int = 0) -> DataFrame:
    """Mean and number of the last days and mean of as many before them, for each length, and the last days as a series, in one pass."""
    age = F.datediff(last, F.col("local_date"))
    aggs = []
    for n in lengths:
        now = (age >= 0) & (age < n)
        aggs += [F.avg(F.when(now, F.col("value"))).alias(f"mean_{n}"), F.avg(F.when((age >= n) & (age < 2 * n), F.col("value"))).alias(f"before_{n}"), F.count_if(now).alias(f"days_{n}")]
    if spark_days:
        line = F.collect_list(F.when((age >= 0) & (age < spark_days), F.struct("local_date", "value")))
        aggs.append(F.array_sort(line).alias("series"))
    return values.groupBy(*keys).agg(*aggs)


def intraday(df: DataFrame, keys: list[str], interval: Column, size: int) -> DataFrame:
    """``(keys, slot, mean, min, max, n, total)`` on a grid of ``size`` microseconds: means of samples, sums of intervals by their share of a slot."""
    lasts = interval & (F.col("end_at") > F.col("start_at"))
    cut = within.parts(df.select(*keys, "value", "start_at", F.when(lasts, F.col("end_at")).otherwise(F.col("start_at")).alias("end_at"), lasts.alias("_lasts")), size)
    sample = F.when(~F.col("_lasts"), F.col("value"))
    return cut.groupBy(*keys, F.col("b").alias("slot")).agg(F.avg(sample).alias("mean"), F.min(sample).alias("min"), F.max(sample).alias("max"), F.count(sample).alias("n"), F.sum(F.when(F.col("_lasts"), F.col("part"))).alias("total"))


def decimate(df: DataFrame, keys: list[str], start: int, size: int) -> DataFrame:
    """``(keys, col, low, high, first, last)``: a series thinned to columns of ``size`` microseconds from ``start`` on."""
    order = F.struct("start_at", "id")
    col = F.floor((F.unix_micros("start_at") - start) / F.lit(size)).alias("col")
    return df.groupBy(*keys, col).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], cell: float) -> DataFrame:
    """``(keys, ...)``: quantiles by linear interpolation, exact, without any group's values in one place.

    Values are counted by cells of a width; the counts say in which cell a rank falls, and only equal
    values of that cell, counted in turn, are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / cell).alias("_c"))
    held = rows.groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_k"))
    cells = held.groupBy(*keys, "_c").agg(F.sum("_k").alias("_k"))
    upto = Window.partitionBy(*keys).orderBy("_c")
    cells = cells.withColumn("_end", F.sum("_k").over(upto)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("_n") - 1) * q).alias("lo"), ((F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q)).alias("w")) for name, q in shares.items()])
    want = cells.withColumn("_r", F.explode(ranks)).withColumn("_from", F.col("_end") - F.col("_k"))
    # the cell of a rank and the one of the rank after it
    want = want.where("_r.lo + 1 >= _from and _r.lo < _end")
    inner = held.join(want.select(*keys, "_c", "_r", "_from").withColumnRenamed("_from", "_base"), [*keys, "_c"])
    place = F.col("_base") + F.sum("_k").over(Window.partitionBy(*keys, "_c", "_r.name").orderBy("_v"))
    ranked = inner.withColumn("_to", place).withColumn("_at", F.col("_to") - F.col("_k"))
    low = F.max(F.when((F.col("_at") <= F.col("_r.lo")) & (F.col("_r.lo") < F.col("_to")), F.col("_v")))
    high = F.max(F.when((F.col("_at") <= F.col("_r.lo") + 1) & (F.col("_r.lo") + 1 < F.col("_to")), F.col("_v")))
    each = ranked.groupBy(*keys, F.col("_r.name").alias("name")).agg((low + (F.coalesce(high, low) - low) * F.max("_r.w")).alias("q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares])


def trend(values: DataFrame, keys: list[str], date: str, unit: str) -> DataFrame:
    """Weeks from Monday, or months, with the first and last day that they hold."""
    return values.groupBy(*keys, F.to_date(F.date_trunc(unit, date)).alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))


def inventory(parts: dict[str, DataFrame]) -> DataFrame:
    """``(kind, n, first_at, last_at, days, newest)`` over ``(id, at, day)`` of each kind of record; days first, so that no distinct count is kept whole."""
    out = None
    for kind, df in parts.items():
        by_day = df.groupBy("day").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("z"), F.max(F.struct("at", "id")).alias("l"))
        one = by_day.agg(F.lit(kind).alias("kind"), F.sum("n").alias("n"), F.min("a").alias("first_at"), F.max("z").alias("last_at"), F.count("day").alias("days"), F.max("l")["id"].alias("newest"))
        out = one if out is None else out.union(one)
    return out


def ordered_sum(df: DataFrame, keys: list, value: str, order: list[str]) -> DataFrame:
    """``(keys, total)`` added up in an order, one after the other; groups must be small, such as a bucket of one source."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["_v"]).alias("total"))
