"""Running totals within groups of any size, in three levels of small windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that one window of the lowest level holds on average, and windows of it in one of the next.
ROWS, FAN = 512, 1024


def running_start(df: DataFrame, keys: list[str], order: list[str], spread: Column, amount: str, out: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of the same ``keys`` that come before.

    Rows are ordered by a bucket of ``spread`` (an even 64-bit hash), then by ``order``.  Buckets keep
    about ``ROWS`` rows whatever the size of a group, so that no window holds a whole group.
    """
    df = scratch.save(df)
    n = max(1, -(-df.count() // ROWS))
    low = df.withColumn("_b", F.pmod(spread, F.lit(n)).cast("long"))
    sums = scratch.save(low.groupBy(*keys, "_b").agg(F.sum(amount).alias("_s")).withColumn("_c", F.expr(f"_b div {FAN}")))
    before = lambda parts, by: Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = sums.groupBy(*keys, "_c").agg(F.sum("_s").alias("_t"))
    coarse = scratch.save(coarse.withColumn("_t0", F.coalesce(F.sum("_t").over(before(keys, ["_c"])), F.lit(0))).drop("_t"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    mid = sums.withColumn("_s0", F.coalesce(F.sum("_s").over(before([*keys, "_c"], ["_b"])), F.lit(0)))
    mid = mid.join(coarse, same(mid, coarse, [*keys, "_c"])).select(*[mid[k] for k in keys], "_b", (F.col("_s0") + F.col("_t0")).alias("_o"))
    mid = scratch.save(mid)
    inner = low.withColumn("_r0", F.coalesce(F.sum(amount).over(before([*keys, "_b"], order)), F.lit(0)))
    done = inner.join(mid, same(inner, mid, [*keys, "_b"]))
    return done.select(*[inner[c] for c in df.columns], (F.col("_r0") + F.col("_o")).cast("long").alias(out))
