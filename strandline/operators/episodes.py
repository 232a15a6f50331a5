"""Spans put together: fragments of one source, episodes over sources, and groups of workouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from strandline.operators import cells
from strandline.operators.components import components
from strandline.operators.joins import HOUR, overlap
from strandline.sources.scratch import Scratch


def islands(spans: DataFrame, keys: list[str], lo: str, hi: str, gap: int, bucket: int | None = None) -> DataFrame:
    """``spans`` with ``island``: spans join while the next starts no later than ``gap`` after the furthest end so far.

    With a ``bucket`` of time no window holds more than a key's rows of one bucket: the furthest end, and the
    number of islands, of the buckets before are carried in.  Keys without an end (a source's whole history) take one.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(lo, hi)
        reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return spans.withColumn("_new", (F.col(lo) - reach > gap).cast("int")).withColumn("island", F.sum(F.coalesce("_new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    own = spans.withColumn("_b", F.floor(F.col(lo) / F.lit(bucket)))
    w, earlier = Window.partitionBy(*keys, "_b").orderBy(lo, hi), Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    far = own.groupBy(*keys, "_b").agg(F.max(hi).alias("_v")).withColumn("_far", F.max("_v").over(earlier))
    reach = F.greatest(F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    cut = _carried(own, far, keys, "_far").withColumn("_new", F.coalesce((F.col(lo) - reach > gap).cast("int"), F.lit(1))).drop("_far")
    begun = cut.groupBy(*keys, "_b").agg(F.sum("_new").alias("_v")).withColumn("_from", F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
    return _carried(cut, begun, keys, "_from").withColumn("island", F.col("_from") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_b", "_from")


def _carried(rows: DataFrame, by_bucket: DataFrame, keys: list[str], column: str) -> DataFrame:
    small = by_bucket.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), column)
    same = F.col("_b") == F.col("_bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(small, same).drop("_bb", *[f"_k_{k}" for k in keys])


#: Buckets of time that a source's whole history is cut into.
MONTH = 30 * 86_400_000_000


def fragments(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", gap: int = 3_600_000_000) -> DataFrame:
    """``(keys, island, lo, hi, pieces)``: spans of one source merged over gaps of an hour at most."""
    return islands(spans, keys, lo, hi, gap, MONTH).groupBy(*keys, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("pieces"))


def overlap_ratio(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Overlap over the shorter span."""
    return F.greatest(F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo), F.lit(0)) / F.least(a_hi - a_lo, b_hi - b_lo)


def covered(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``(keys, length)`` of the union of spans."""
    return islands(spans, keys, lo, hi, 0, MONTH).groupBy(*keys, "island").agg(F.min(lo).alias("_l"), F.max(hi).alias("_h")).groupBy(*keys).agg(F.sum(F.col("_h") - F.col("_l")).alias("length"))


def links(spans: DataFrame, keys: list[str], least: float, size: int = 3_600_000_000) -> DataFrame:
    """``(keys, a, b, ratio, ...)``: pairs of ``spans(keys, id, lo, hi)`` of equal keys that overlap by ``least`` of the shorter.

    ``a`` starts first, or has the smaller id of two that start together.  Spans are cut at a grid and
    meet by equal cells, so that no task holds all spans of a key.
    """
    rest = [c for c in spans.columns if c not in keys]
    left, right = (spans.withColumnsRenamed({c: f"{s}_{c}" for c in rest}) for s in "ab")
    both = overlap(left, right, keys, ("a_lo", "a_hi"), ("b_lo", "b_hi"), size).where("struct(a_lo, a_id) < struct(b_lo, b_id)")
    ratio = overlap_ratio(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    return both.withColumn("ratio", ratio).where(F.col("ratio") >= least).withColumnsRenamed({"a_id": "a", "b_id": "b"})


def clusters(spans: DataFrame, keys: list[str], least: float, name: str = "clusters") -> DataFrame:
    """``spans(keys, id, lo, hi)`` with ``cluster``, the least id among spans that overlap by ``least`` of the shorter, directly or through others."""
    scratch = Scratch(spans.sparkSession, name)
    found = components(links(spans, keys, least).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    found = scratch.save(found.groupBy("node").agg(F.min("component").alias("cluster")))
    return spans.join(found, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("cluster", "id")).drop("node")


def best_first_clusters(spans: DataFrame, keys: list[str], least: float, kind: str, name: str = "best_first", size: int = 6 * HOUR) -> DataFrame:
    """``spans`` with ``cluster`` (its least id), where links count by falling overlap and a cluster holds one specific ``kind`` at most.

    Of equal overlaps the pair that starts first counts first; a null kind is unspecific.  The result is that
    of taking all links one by one, but they are never listed.  An unspecific span comes to the kind that it
    reaches by better links than any other: that of its tree, where spans with a kind are roots and every link
    counts that is not the last of a circle.  Links of a cell of time that are the last of a circle there are
    left out at once, so that a row or two for each span remain.  As every link between spans that come to one
    kind, or to none, is taken when its turn comes, clusters are then what hangs together within a kind.
    """
    scratch = Scratch(spans.sparkSession, name)
    whole = F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    spans = spans.where("id is not null")
    cell = F.explode(F.sequence(F.expr(f"floor(lo / {size}D)"), F.expr(f"floor((hi - 1) / {size}D)"))).alias("_cell")
    met = spans.where(whole).select(*keys, "id", "lo", "hi", F.col(kind).alias("_kind"), cell)
    schema = StructType([StructField(c, spans.schema[kind].dataType if c == "kind" else DoubleType() if c == "ratio" else LongType()) for c in ("u", "v", "kind", "ratio", "a_lo", "a", "b_lo", "b")])
    found = scratch.save(met.groupBy(*keys, "_cell").applyInArrow(cells.told(least, size, to_arrow_schema(schema)), schema))
    kinds = found.where("ratio is null").select(F.col("u").alias("id"), F.col("kind").alias("_told")).unionByName(_rooted(found.where("ratio is not null"), scratch))
    own = spans.where(F.col(kind).isNotNull()).withColumn("_kind", F.col(kind)).unionByName(spans.where(F.col(kind).isNull()).join(kinds, "id", "left").withColumnRenamed("_told", "_kind"))
    parts = own.where(whole).select(*spans.columns, "_kind", cell)
    shape = StructType([*spans.schema.fields, StructField("_part", LongType()), StructField("_first", BooleanType()), StructField("_many", BooleanType())])
    parts = scratch.save(parts.groupBy(*keys, "_cell").applyInArrow(cells.parted(least, size), shape))
    # a span in several cells puts its parts there together
    same = parts.where("_many").groupBy("id").agg(F.min("_part").alias("u"), F.collect_set("_part").alias("v")).select("u", F.explode("v").alias("v"))
    into = components(same, scratch)
    out = parts.where("_first").join(into, F.col("_part") == F.col("node"), "left").select(*spans.columns, F.coalesce("component", "_part").alias("cluster"))
    return out.unionByName(spans.where(~whole).withColumn("cluster", F.col("id").cast("long")))


def _rooted(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, _told)`` of the spans ``u`` that come to a kind by the links ``found(u, v, kind, ratio, a_lo, a, b_lo, b)``, ``v`` being null where the link is to a kind.

    In each round every cluster takes its best link; clusters that stay without a kind halve at least.
    """
    left = scratch.save(found.select("u", "v", "kind", F.struct((-F.col("ratio")).alias("r"), "a_lo", "a", "b_lo", "b").alias("rank")).distinct())
    state = scratch.save(left.select(F.explode(F.array("u", "v")).alias("id")).where("id is not null").distinct().select("id", F.col("id").alias("cluster"), F.lit(None).cast(found.schema["kind"].dataType).alias("_told")))
    while not left.isEmpty():
        ends = left.select("rank", F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("d"), "kind"), F.struct(F.col("v").alias("c"), F.col("u").alias("d"), "kind"))).alias("e")).select("rank", "e.*").where("c is not null")
        best = scratch.save(ends.groupBy("c").agg(F.min(F.struct("rank", "d", "kind")).alias("e")).select("c", "e.d", "e.kind"))
        tied = components(best.where("d is not null").select(F.col("c").alias("u"), F.col("d").alias("v")), scratch)
        into = best.join(tied, F.col("c") == F.col("node"), "left").select("c", F.coalesce("component", "c").alias("new"), "kind")
        # of the links that a cluster is made of, one at most leads to a kind
        into = scratch.save(into.join(into.groupBy("new").agg(F.max("kind").alias("now")), "new").select("c", "new", "now"))
        old_state, old_left = state, left
        state = scratch.save(state.join(into, F.col("cluster") == F.col("c"), "left").select("id", F.coalesce("new", "cluster").alias("cluster"), F.coalesce("_told", "now").alias("_told")))
        for end in ("u", "v"):
            left = left.join(into.select(F.col("c").alias(end), F.col("new").alias(f"n_{end}"), F.col("now").alias(f"k_{end}")), end, "left").withColumn(end, F.coalesce(f"n_{end}", end))
        left = left.where("(k_u is null or (k_v is null and v is not null)) and not (u <=> v)")
        reached = F.when(F.col("k_v").isNotNull(), F.struct(F.col("u").alias("u"), F.lit(None).cast("long").alias("v"), F.col("k_v").alias("kind"))).when(F.col("k_u").isNotNull(), F.struct(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.col("k_u").alias("kind")))
        one = left.select("rank", F.coalesce(reached, F.struct(F.when(F.col("v").isNull(), F.col("u")).otherwise(F.least("u", "v")).alias("u"), F.when(F.col("v").isNotNull(), F.greatest("u", "v")).alias("v"), F.col("kind"))).alias("e")).select("rank", "e.*")
        # between two clusters, and from one to any kind, the best link stays
        left = scratch.save(one.groupBy("u", "v").agg(F.min(F.struct("rank", "kind")).alias("e")).select("u", "v", "e.kind", "e.rank"))
        scratch.drop(old_state, old_left, best, into)
    return state.where("_told is not null").select("id", "_told")


def pick(spans: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One span of each cluster: the first group of the rule, then the longest, then the earliest; spans that the rule excludes (below 0) or doesn't match (null) are never picked.

    ``alternates`` counts the others of the cluster that could be shown beside it, those that are never picked among
    them; a cluster of none that can be picked has no span.
    """
    rest = [c for c in spans.columns if c not in keys]
    may = F.col(position) >= 0
    out = spans.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.when(may, F.struct(position, F.col("lo") - F.col("hi"), "lo", "id"))).alias("r"), F.count("*").alias("_n"))
    return out.select(*keys, "r.*", (F.col("_n") - F.when(F.col("r").isNull(), 0).otherwise(1)).alias("alternates"))
