"""Optional filters and pages by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, sources: list[str] | None = None, owners: list[int] | None = None, dates: tuple[str, str] | None = None, low: float | None = None, high: float | None = None, flags: int | None = None) -> DataFrame:
    """``df`` by those conditions that are given; the others aren't in the plan at all."""
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    if owners is not None:
        df = df.where(F.col("owner").isin(owners))
    if dates is not None:
        df = df.where(F.col("local_date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    if low is not None:
        df = df.where(F.col("value") >= low)
    if high is not None:
        df = df.where(F.col("value") <= high)
    return df if flags is None else df.where(F.col("flags") == flags)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after a key in order, and one more if there are more."""
    if after is not None:
        late, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            late = late | (same & (F.col(k) > F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        df = df.where(late)
    return df.orderBy(*keys).limit(size + 1)
