"""Which rows take part in a rule, and in which of its groups."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED = -1


@dataclass(frozen=True)
class Selector:
    """Fields of a source that must all agree; a field that is not set agrees with anything, a set one never with a null."""

    source: str | None = None
    provider: str | None = None
    device: str | None = None
    device_type: str | None = None
    model: str | None = None
    manual: bool | None = None
    origin_prefix: str | None = None
    manufacturer: str | None = None

    def column(self) -> Column:
        parts = []
        for f in fields(self):
            want = getattr(self, f.name)
            if want is None:
                continue
            if f.name == "origin_prefix":
                parts.append(F.col("origin").startswith(want))
            elif f.name == "manufacturer":
                parts.append(F.lower("manufacturer") == want.lower())
            else:
                parts.append(F.col(f.name) == F.lit(want))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


@dataclass(frozen=True)
class Group:
    """A named group of sources: any of its selectors will do."""

    name: str
    selectors: tuple[Selector, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, [s.column() for s in self.selectors], F.lit(False))


def position(groups: tuple[Group, ...], exclude: tuple[Selector, ...] = ()) -> Column:
    """Place of the first group that a source matches; ``EXCLUDED`` beats every group; null is outside the rule."""
    out = F.when(reduce(lambda a, b: a | b, [s.column() for s in exclude], F.lit(False)), F.lit(EXCLUDED))
    for i, g in enumerate(groups):
        out = out.when(g.column(), F.lit(i))
    return out


def membership(pos: Column) -> Column:
    return F.when(pos.isNull(), "not_in_rule").when(pos == EXCLUDED, "excluded").otherwise("grouped")


def row_gate(mask: int = 0, low: float | None = None, high: float | None = None) -> Column:
    """Why a row is dropped: a flag of the mask, or a value outside a range whose bounds differ; null if it isn't."""
    out = F.when(F.col("flags").bitwiseAND(F.lit(mask)) != 0, "flagged")
    if low is not None and high is not None and high > low:
        out = out.when(~F.col("value").between(low, high), "implausible")
    return out


def family_gate(df: DataFrame, reading: list[str], reason: Column) -> DataFrame:
    """``df`` without the readings that hold any dropped component."""
    bad = F.max(reason.isNotNull()).over(Window.partitionBy(*reading))
    return df.withColumn("_bad", bad).where(~F.col("_bad")).drop("_bad")
