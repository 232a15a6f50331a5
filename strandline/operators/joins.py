"""Joins on time that plan as equal-key joins, never as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def overlap(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], size: int = HOUR) -> DataFrame:
    """Pairs of rows with the same keys whose spans [lo, hi) in microseconds overlap.

    Both sides are cut at a grid; a pair counts in the first cell that both reach, so it comes once.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.expr(f"floor({lo} / {size}D)"), F.expr(f"floor(({hi} - 1) / {size}D)")))
    a = left.where(F.col(l_span[1]) > F.col(l_span[0])).withColumn("_cell", cells(*l_span))
    b = right.where(F.col(r_span[1]) > F.col(r_span[0])).withColumn("_cell", cells(*r_span))
    both = a.join(b, [*keys, "_cell"])
    lo = F.greatest(F.col(l_span[0]), F.col(r_span[0]))
    return both.where((lo < F.least(F.col(l_span[1]), F.col(r_span[1]))) & (F.expr(f"floor(greatest({l_span[0]}, {r_span[0]}) / {size}D)") == F.col("_cell"))).drop("_cell")


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], size: int = HOUR) -> DataFrame:
    """Points with the spans [lo, hi) of the same keys that hold them."""
    a = points.withColumn("_cell", F.expr(f"floor({at} / {size}D)"))
    b = spans.where(F.col(span[1]) > F.col(span[0])).withColumn("_cell", F.explode(F.sequence(F.expr(f"floor({span[0]} / {size}D)"), F.expr(f"floor(({span[1]} - 1) / {size}D)"))))
    return a.join(b, [*keys, "_cell"]).where((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("_cell")


def fuzzy(incoming: DataFrame, known: DataFrame, keys: list[str], seconds: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """Rows of ``incoming`` that a row of ``known`` repeats: same keys, start and end (``s``, ``e``, microseconds) within a second, values within a tolerance relative to the incoming one (taken as a millionth at least); a NaN value agrees with any."""
    reach = int(seconds * 1_000_000)
    a = incoming.withColumn("_cell", F.explode(F.expr(f"sequence(floor(s / {reach}D) - 1, floor(s / {reach}D) + 1)")))
    b = known.select(*keys, F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("value").alias("_v"), F.expr(f"floor(s / {reach}D)").alias("_cell"))
    close = F.isnan("value") | (F.abs(F.col("value") - F.col("_v")) <= tolerance * F.greatest(F.abs("value"), F.lit(1e-6)))
    met = (F.abs(F.col("s") - F.col("_s")) < reach) & (F.abs(F.col("e") - F.col("_e")) < reach) & close
    return a.join(b, [*keys, "_cell"]).where(met).select(*incoming.columns).distinct()


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, by one aggregation and no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


#: Patterns that come to the driver at most, and patterns in one regular expression.
PATTERNS, AT_ONCE = 10_000, 250


def like_regex(pattern: str) -> str:
    """A LIKE pattern (escape: backslash) as a regular expression of Java that the whole text has to match."""
    out, plain, i = [], "", 0
    quoted = lambda t: "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" if t else ""
    while i < len(pattern):
        c = pattern[i]
        if c in "%_":
            out.append(quoted(plain) + (".*" if c == "%" else "."))
            plain = ""
        else:
            i += c == "\\" and i + 1 < len(pattern)
            plain += pattern[i]
        i += 1
    return "".join([*out, quoted(plain)])


def any_like(rows: DataFrame, patterns: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows that match a LIKE pattern of a list: one filter over the rows, which are neither joined nor shuffled.

    A list that people keep is short: up to ``PATTERNS`` distinct ones become regular expressions of
    ``AT_ONCE`` alternatives each; a longer list is an error, never cut.  Null patterns and null texts match nothing.
    """
    found = sorted(r[0] for r in patterns.select(pattern).where(F.col(pattern).isNotNull()).distinct().limit(PATTERNS + 1).collect())
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    met = F.lit(False)
    for i in range(0, len(found), AT_ONCE):
        met = met | F.col(column).rlike("(?s)\\A(?:" + "|".join(map(like_regex, found[i : i + AT_ONCE])) + ")\\z")
    return rows.where(met)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str], bucket: int = HOUR * 24, lookback: int | None = None) -> DataFrame:
    """``left`` with ``found``, the row of ``right`` with the same keys that is the latest at or before ``at`` (microseconds).

    ``order`` are the columns of ``right`` that it is ordered by, its instant first; ``lookback``: rows
    older than that don't count.  The last row of each bucket of time is carried to the later ones, so
    that no window holds all rows of a key.
    """
    when, rest = order[0], [c for c in right.columns if c not in keys]
    r = right.select(*keys, F.expr(f"`{when}` div {bucket}").alias("_b"), F.col(when).alias("_t"), F.struct(*order).alias("_o"), F.struct(*rest).alias("_row"))
    own = left.withColumn("_b", F.expr(f"`{at}` div {bucket}"))
    ends = r.groupBy(*keys, "_b").agg(F.max_by("_row", "_o").alias("_end"))
    every = ends.select(*keys, "_b").union(own.select(*keys, "_b")).distinct().join(ends, [*keys, "_b"], "left")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_b", F.last("_end", ignorenulls=True).over(upto(*keys).orderBy("_b")).alias("_far"))
    marks = own.select(*keys, "_b", F.col(at).alias("_t"), F.lit(None).cast(r.schema["_o"].dataType).alias("_o"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), F.struct(*left.columns).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(marks.schema["_l"].dataType)).select(marks.columns).union(marks)
    near = F.last("_row", ignorenulls=True).over(upto(*keys, "_b").orderBy("_t", F.col("_l").isNotNull(), "_o"))
    out = both.withColumn("_near", near).where("_l is not null").join(carried, [*keys, "_b"], "left").withColumn("found", F.coalesce("_near", "_far"))
    if lookback is not None:
        out = out.withColumn("found", F.when(F.col(f"found.{when}") >= F.col("_t") - lookback, F.col("found")))
    return out.select("_l.*", "found")
