"""Mixing sources to target weights, by words packed into fixed-length blocks.

The words of a source, in a pseudorandom order of its documents, are packed into blocks of fixed
length.  Output shards draw multinomial counts of blocks per source.  The slots a source was given
are numbered through and mapped to its blocks by a pseudorandom permutation of the block indices, a
fresh one for every pass through the source, and joined with the blocks by index.  Draws beyond a
source's quota are void and missing ones are added in a last shard, so that every source ends on its
target; the last slot of a source may take only the head of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import running_start
from .scratch import Scratch
from .textkit import groups, lean, mix64, text_bytes, word_spans

#: Words in a block, blocks in an output shard.
BLOCK, SHARD = 512, 4096

def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``most`` times its size.

    What a limit cuts off goes to the sources below theirs, by weight, until none is above.
    """
    out = [0.0] * len(sizes)
    left, total = share * sum(sizes), sum(w for w, n in zip(weights, sizes, strict=True) if n > 0)
    # a source with fewer words for its weight reaches its limit first
    order = sorted((i for i, n in enumerate(sizes) if n > 0), key=lambda i: (sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        if left * weights[i] / total <= most * sizes[i]:
            for j in order[k:]:
                out[j] = left * weights[j] / total
            break
        out[i] = float(most * sizes[i])
        left, total = left - out[i], total - weights[i]
    return out


def permute(i: np.ndarray, n: int, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of ``range(n)`` at ``i``: four Feistel rounds over the next even power of two, walked until inside.

    ``back``: the inverse, by the same rounds in reverse, so that a slot is found without a search.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        x, s = out[todo], seed[todo]
        left, right = x >> half, x & mask
        for r in reversed(range(4)) if back else range(4):
            key = s + np.uint64(0x9E37 * (r + 1))
            if back:
                left, right = right ^ (mix64(left + key) & mask), left
            else:
                left, right = right, left ^ (mix64(right + key) & mask)
        out[todo] = left << half | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass
class Plan:
    """What one source gives: its blocks, the quota of slots and the words of the last slot."""

    size: int
    target: float
    blocks: int
    tail: int
    slots: int
    last: int


def plan_source(size: int, target: float, seed: int, block: int) -> Plan:
    blocks = -(-size // block)
    want = int(target + 0.5)
    if not size or not want:
        return Plan(size, target, blocks, 0, 0, 0)
    tail = size - (blocks - 1) * block
    passes, rest = divmod(want, size)
    if not rest:
        return Plan(size, target, blocks, tail, passes * blocks, block)
    # Slot at which the short last block comes up in the last pass: the rest ends before, in or after it.
    at = slot_of(blocks - 1, passes, blocks, seed)
    before = at * block
    if rest <= before:
        used, last = -(-rest // block), rest - (-(-rest // block) - 1) * block
    elif rest <= before + tail:
        used, last = at + 1, rest - before
    else:
        more = rest - before - tail
        used, last = at + 1 + -(-more // block), more - (-(-more // block) - 1) * block
    return Plan(size, target, blocks, tail, passes * blocks + used, last)


def slot_blocks(slots: np.ndarray, blocks: int, seed: int) -> np.ndarray:
    """Block index of each slot of a source: one permutation of all its blocks per pass."""
    passes = slots // blocks
    keys = mix64(passes.astype(np.uint64) + np.uint64(seed))
    return permute(slots % blocks, blocks, keys)


def slot_of(index: int, passes: int, blocks: int, seed: int) -> int:
    """The slot, counted from the start of a pass, at which a block of a source comes up."""
    key = mix64(np.array([passes], np.uint64) + np.uint64(seed))
    return int(permute(np.array([index], np.int64), blocks, key, back=True)[0])


def _draw(probabilities: list[float], total: int, shard: int, seed: int):
    """Task function: shard numbers to (shard, s, count), multinomial in each shard."""
    p = np.array(probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            counts = np.array([np.random.default_rng([seed, j]).multinomial(min(shard, total - j * shard), p) for j in ids]).reshape(len(ids), len(p))
            a, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[a]), pa.array(b.astype(np.int64)), pa.array(counts[a, b].astype(np.int64))], names=["shard", "s", "count"])

    return run


def _expand(plans: list[Plan], seeds: list[int], block: int):
    """Task function: (shard, s, first, count) to (s, slot, shard, block, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = plans[s]
                for lo in range(first, min(first + count, p.slots), 1 << 16):
                    slots = np.arange(lo, min(lo + (1 << 16), first + count, p.slots))
                    index = slot_blocks(slots, p.blocks, seeds[s])
                    words = np.where(index == p.blocks - 1, p.tail, block)
                    words = np.where(slots == p.slots - 1, np.minimum(words, p.last), words)
                    same = lambda v: pa.array(np.full(len(slots), v, np.int64))
                    yield pa.RecordBatch.from_arrays([same(s), pa.array(slots), same(shard), pa.array(index), pa.array(words.astype(np.int64))], names=["s", "slot", "shard", "block", "words"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off, _ = text_bytes(batch.column(2))
        n = [np.diff(word_spans(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[2]) for lo, hi in groups(off)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.concatenate(n or [np.zeros(0)]).astype(np.int64))], names=["id", "source", "key", "size"])


@dataclass
class Mix:
    """A mix: ``documents(id, source, key, s, size, start)``, ``slots(s, slot, shard, block, words)`` and ``sources(s, source, source_size, target)``."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame
    block: int
    scratch: Scratch

    def pieces(self) -> DataFrame:
        """``(id, source, s, size, a, b, full, words)``: words [a, b) of a document and how often the mix takes them.

        ``full`` counts the slots that take the whole block; ``words`` is the head of the block that
        one more slot takes (0: none); ``at`` is where the piece begins in its block.
        """
        b = self.block
        taken = self.slots.withColumn("whole", F.expr(f"words = {b} or words = tail"))
        taken = taken.groupBy("s", "block").agg(F.sum(F.col("whole").cast("long")).alias("full"), F.max(F.when(~F.col("whole"), F.col("words"))).alias("words"))
        taken = self.scratch.save(taken)
        parts = self.documents.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        parts = parts.withColumn("a", F.expr(f"greatest(start, block * {b}) - start")).withColumn("b", F.expr(f"least(start + size, (block + 1) * {b}) - start"))
        parts = parts.withColumn("at", F.expr(f"start + a - block * {b}"))
        return parts.join(taken, ["s", "block"], "left").select("id", "row", "key", "source", "s", "size", "a", "b", "at", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("words", F.lit(0)).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 7, name: str = "mix", key_col: str | None = None) -> Mix:
    """Mix all documents of ``docs`` to target weights.

    Sources in the order of their code points, null last, get ``weights`` in turn.  A null text has no
    words and is never taken; repeated rows are documents of their own, in any order, for they are
    alike; an empty table gives an empty mix; other columns are ignored.  The same input gives the same
    mix, however it is partitioned.  One row for each source comes to the driver, however many there
    are: a mix is configured source by source.  ``key_col`` names a column of row numbers to carry along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key"))
    told = scratch.save(told.mapInArrow(lean(_count_words), "id long, source string, key long, size long"))
    totals = told.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source that is mixed
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    seeds = [int(mix64(np.array([seed * 1_000_003 + i], np.uint64))[0]) & 0x7FFFFFFFFFFFFFFF for i in range(len(sizes))]
    plans = [plan_source(n, t, s, block) for n, t, s in zip(sizes, goal, seeds, strict=True)]
    sources = spark.createDataFrame([(i, r.source, p.size, p.target, p.tail, p.blocks) for i, (r, p) in enumerate(zip(totals, plans, strict=True))], "s long, source string, source_size long, target double, tail long, blocks long")

    total = sum(p.slots for p in plans)
    if total:
        chance = [p.slots / total for p in plans]
        shards = -(-total // shard)
        drawn = scratch.save(spark.range(shards).mapInArrow(_draw(chance, total, shard, seed), "shard long, s long, count long"))
        drawn = running_start(drawn, ["s"], ["shard"], F.xxhash64("shard"), "count", "first", scratch).select("shard", "s", "first", "count")
        got = {r.s: r.n for r in drawn.groupBy("s").agg(F.sum("count").alias("n")).collect()}
        short = [(shards, i, got.get(i, 0), p.slots - got.get(i, 0)) for i, p in enumerate(plans) if p.slots > got.get(i, 0)]
        drawn = drawn.union(spark.createDataFrame(short, "shard long, s long, first long, count long"))
    else:
        drawn = spark.createDataFrame([], "shard long, s long, first long, count long")
    slots = drawn.mapInArrow(_expand(plans, seeds, block), "s long, slot long, shard long, block long, words long")
    slots = slots.join(sources.select("s", "tail", "blocks"), "s").withColumn("tail", F.expr("if(block = blocks - 1, tail, -1)")).drop("blocks")
    numbered = told.join(sources.select("s", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    numbered = running_start(numbered, ["s"], ["id", "size"], F.xxhash64("id", F.lit(seed)), "size", "start", scratch)
    # rows that agree in everything but their place are told apart by it
    numbered = numbered.withColumn("row", F.col("start"))
    return Mix(scratch.save(numbered), slots, sources, block, scratch)


def taken_words(m: Mix) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every document of a mix."""
    took = F.expr("(b - a) * full + greatest(0L, least(b - a, words - at))")
    taken = m.pieces().groupBy("id", "s", "row").agg(F.sum(took).alias("taken"))
    taken = m.scratch.save(taken)
    d = m.documents
    same = d["id"].eqNullSafe(taken["id"]) & (d["s"] == taken["s"]) & (d["row"] == taken["row"]) & (d["size"] > 0)
    out = d.join(taken, same, "left").join(m.sources.select(F.col("s").alias("_s"), "source_size", "target"), F.col("_s") == d["s"])
    return out.select(d["id"], d["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _segments(parts: list[dict]) -> list[list[int]]:
    """[a, b, times] runs of a document's words that the mix takes equally often, from its pieces."""
    out: list[list[int]] = []
    for p in sorted(parts, key=lambda x: x["a"]):
        head = p["a"] + max(0, min(p["b"] - p["a"], p["words"] - p["at"]))
        for a, b, times in ((p["a"], head, p["full"] + 1), (head, p["b"], p["full"])):
            if a < b and out and out[-1][1] == a and out[-1][2] == times:
                out[-1][1] = b
            elif a < b:
                out.append([a, b, times])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, parts, other columns) to (other columns, text): one row each time the mix takes a run of words, with the white space that follows them."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for i, parts in enumerate(batch.column(1).to_pylist()):
            data, off, _ = text_bytes(batch.column(0).slice(i, 1))
            starts, _, _ = word_spans(data, off)
            edge = np.concatenate([[0], starts[1:], [len(data)]])
            for a, b, times in _segments(parts):
                text = data[edge[a] : edge[b]].tobytes().decode()
                for _ in range(times):
                    rows.append(i)
                    texts.append(text)
                    held += len(text)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[2:]), pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "_text"])
                        rows, texts, held = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[2:]), pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "_text"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mixed", **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each run of a document's words, as often as it is taken.

    A document whose blocks are all taken equally often stays in one piece, once or twice; one that the
    end of a source's quota cuts comes in parts; one that is not taken, or has no words, goes.  Other
    columns stay, whatever their names; nulls, repeated rows and empty tables are as in ``mix``.
    """
    scratch = Scratch(docs.sparkSession, name)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = scratch.save(docs.toDF(*at.values()).withColumn("_row", F.monotonically_increasing_id()))
    m = mix(kept, at[id_col], at[text_col], at[source_col], name=name, key_col="_row", **options)
    parts = m.pieces().where("full > 0 or words > at").groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("a", "b", "at", "full", "words")).alias("_parts"))
    rows = kept.join(scratch.save(parts), F.col("_row") == F.col("_key"))
    other = [c for c in at.values() if c != at[text_col]]
    out = rows.select(F.col(at[text_col]).cast("string").alias("_in"), "_parts", *other)
    schema = T.StructType([*(kept.schema[c] for c in other), T.StructField("_text", T.StringType())])
    done = out.mapInArrow(lean(_cut), schema)
    return done.select(*["_text" if c == at[text_col] else c for c in at.values()]).toDF(*docs.columns)
