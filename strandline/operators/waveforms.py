"""Sampled series kept as one row with an array, its start and its rate: decoded, thinned and joined by time with array functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import overlap

SECOND = 1_000_000


def step(rate: Column) -> Column:
    """Microseconds between two samples at ``rate`` samples a second, as a fraction."""
    return F.lit(float(SECOND)) / rate


def ended(waves: DataFrame) -> DataFrame:
    """``waves(..., start, rate, samples)`` with ``end``, the instant after the last sample; series without samples, rate or start are left out."""
    w = waves.where("start is not null and rate > 0 and samples is not null and size(samples) > 0")
    return w.withColumn("end", F.col("start") + F.ceil(F.size("samples") * step(F.col("rate"))).cast("long"))


def decoded(waves: DataFrame) -> DataFrame:
    """One row for each sample: its number ``i``, its instant ``at`` and its ``value``; null samples stay, as gaps."""
    w = ended(waves)
    rest = [c for c in w.columns if c not in ("samples", "end", "start", "rate")]
    return w.select(*rest, "start", "rate", F.posexplode("samples").alias("i", "value")).select(*rest, "i", (F.col("start") + F.floor(F.col("i") * step(F.col("rate")))).cast("long").alias("at"), "value")


def thinned(waves: DataFrame, columns: int) -> DataFrame:
    """``waves`` with ``low`` and ``high``: the least and the largest sample of each of ``columns`` parts of equal length, in order.

    What a chart of that width shows of a series of any length.  A series with fewer samples has a part for each;
    a part of nulls alone is null.  No row is taken apart: a series stays in its task.
    """
    w = ended(waves)
    n = F.size("samples")
    parts = F.least(n, F.lit(columns))
    edge = lambda k: F.floor(k * n / parts).cast("int")
    piece = lambda k: F.slice(F.col("samples"), edge(k) + 1, F.greatest(edge(k + 1) - edge(k), F.lit(1)))
    each = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.array_min(piece(k)).alias("low"), F.array_max(piece(k)).alias("high")))
    return w.withColumn("_p", each).withColumn("low", F.col("_p.low")).withColumn("high", F.col("_p.high")).drop("_p")


def within(waves: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of series inside ``spans(keys, lo, hi, ...)`` that overlap them: ``part_start`` and ``part``, the samples whose instants are in [lo, hi)."""
    met = overlap(ended(waves), spans, keys, ("start", "end"), ("lo", "hi"))
    s = step(F.col("rate"))
    # the instant of sample i is start + floor(i * step)
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("start")) / s)).cast("int")
    last = F.least(F.size("samples"), F.ceil((F.col("hi") - F.col("start")) / s).cast("int"))
    met = met.withColumn("_a", first).withColumn("_b", last).where("_b > _a")
    return met.withColumn("part_start", (F.col("start") + F.floor(F.col("_a") * s)).cast("long")).withColumn("part", F.slice("samples", F.col("_a") + 1, F.col("_b") - F.col("_a"))).drop("_a", "_b")
