"""How far the sources of a language use different words: exact counts behind a sketch that drops rare terms early.

Most terms of a corpus are in too few documents to count, and each would cost a row for every source.  A
count-min sketch of document frequencies is built first: every task counts into its own, the sketches
are merged block by block, and the merged one, of a fixed size, goes to all tasks.  It never tells less
than the true frequency, so a term that it finds too rare is too rare; the others are shuffled, counted
exactly and checked again.  Sources are then compared through the terms that both have (a join by term),
and through the number of terms for each count for those that only one has, so the terms that a source
doesn't have are never listed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import _LOWER, groups, lean, mix64, text_bytes, word_hashes, word_spans

#: A language keeps the terms of so many of its documents at least; terms are listed to so many ranks.
LEAST, RANKS = 3, 200

#: The sketch: rows of counters, counters of a row (a power of two) and counters of a block.  8 MB in all, whatever the corpus.
DEPTH, WIDTH, BLOCK = 4, 1 << 21, 1 << 16

#: Bytes of text counted together, so that a term of many documents gives one row.
BYTES = 1 << 23

#: Rows that a source's terms are spread over before the best are picked among all.
SPREAD = 64

_APART = np.ones(256, dtype=bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and for each occurrence the number of its term and of its text, in order."""
    data, offsets, _ = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, _APART)
    letters = _LOWER[data[~_APART[data]]]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))


def _hashes(names: pa.Array) -> np.ndarray:
    data, offsets, _ = text_bytes(names)
    return word_hashes(data, offsets[:-1], offsets[1:], lower=False)


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = column.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def _cells(langs: pa.Array, names: pa.Array, pairs: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The counter of each pair (language * number of terms + term), for every row of the sketch."""
    seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in langs.to_pylist()], np.uint64)
    h = mix64(_hashes(names)[pairs % len(names)] ^ seed[pairs // len(names)])
    for d in range(DEPTH):
        yield d, (mix64(h + np.uint64(d * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Parts of the batches, of about ``size`` bytes of text, with their terms; parts without a term are left out."""
    for batch in batches:
        _, offsets, _ = text_bytes(batch.column("text"))
        for lo, hi in groups(offsets, size):
            part = batch.slice(lo, hi - lo)
            names, term, doc = terms(part.column("text"))
            if len(term):
                yield part, names, term, doc


def _sketched(least: int, width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((DEPTH, width), np.uint32)
        for part, names, term, doc in _pieces(batches, size):
            langs, lang = _coded(part.column("lang"))
            once = np.unique(doc * len(names) + term)  # each term counts once for a document
            pairs, n = np.unique(lang[once // len(names)] * len(names) + once % len(names), return_counts=True)
            for d, cell in _cells(langs, names, pairs, width):
                np.add.at(seen[d], cell, np.minimum(n, least).astype(np.uint32))
                seen[d, cell] = np.minimum(least, seen[d, cell])
        yield from _blocks(seen.astype(np.uint8))

    return lean(run)


def _blocks(seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = seen.reshape(-1)
    step = min(BLOCK, len(flat))
    context = TaskContext.get()
    salt = context.partitionId() % 16 if context is not None else 0  # the same when a lost task runs again
    for b in range(len(flat) // step):
        part = flat[b * step : (b + 1) * step]
        if part.any():
            yield pa.record_batch({"block": pa.array([b], pa.int32()), "salt": pa.array([salt], pa.int32()), "cells": pa.array([zlib.compress(part.tobytes(), 1)])})


def _merged(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sketches of a task's blocks added up, one after the other; counters stop at ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("cells")):
                new = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                held[b] = np.minimum(least, held[b].astype(np.uint16) + new).astype(np.uint8) if b in held else new
        for b, cells in held.items():
            yield pa.record_batch({"block": pa.array([b], pa.int32()), "salt": pa.array([0], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)])})

    return run


def sketch(docs: DataFrame, least: int = LEAST, width: int = WIDTH, size: int = BYTES) -> np.ndarray:
    """Counters of the document frequency of ``(lang, term)``, each stopped at ``least``; ``DEPTH * width`` bytes on the driver."""
    kind = "block int, salt int, cells binary"
    parts = docs.select("lang", "text").mapInArrow(_sketched(least, width, size), kind)
    parts = parts.repartition("block", "salt").mapInArrow(_merged(least), kind).repartition("block").mapInArrow(_merged(least), kind)
    out = np.zeros(DEPTH * width, np.uint8)
    step = min(BLOCK, len(out))
    for r in parts.collect():  # DEPTH * width bytes at most, before they are compressed
        out[r.block * step : (r.block + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.cells)), np.uint8)
    return out.reshape(DEPTH, width)


def counts(docs: DataFrame, seen: np.ndarray, least: int = LEAST, size: int = BYTES) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of the terms that the sketch finds in ``least`` documents or more."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for part, names, term, doc in _pieces(batches, size):
            langs, lang = _coded(part.column("lang"))
            sources, source = _coded(part.column("source"))
            k = len(names)
            group = lang * len(sources) + source
            # occurrences are sorted once; a document's terms are then counted by group
            once, times = np.unique(doc * k + term, return_counts=True)
            keys, inverse, held = np.unique(group[once // k] * k + once % k, return_inverse=True, return_counts=True)
            n = np.bincount(inverse, times, len(keys)).astype(np.int64)
            enough = np.ones(len(keys), bool)
            for d, cell in _cells(langs, names, keys // k // len(sources) * k + keys % k, seen.shape[1]):
                enough &= seen[d, cell] >= least
            keys, n, held = keys[enough], n[enough], held[enough]
            g = keys // k
            yield pa.record_batch({
                "lang": langs.take(pa.array(g // len(sources))), "source": sources.take(pa.array(g % len(sources))),
                "term": names.take(pa.array(keys % k)).cast(pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64()), "docs": pa.array(held, pa.int64()),
            })

    found = docs.select("lang", "source", "text").mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str, kept: str) -> Column:
    """Billionths of a term that is there ``n`` times, smoothed by one; exact whatever the counts."""
    return F.expr(f"1L + CASE WHEN {n} < 9000000000 THEN (1000000000L * ({n} + 1)) div ({total} + {kept}) ELSE (cast(1000000000 AS decimal(10,0)) * cast({n} + 1 AS decimal(20,0))) div cast({total} + {kept} AS decimal(20,0)) END")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, ranks: int = RANKS, width: int = WIDTH, size: int = BYTES, name: str = "divergence") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of each source to the others of its language, and the terms that stand out in it.

    Terms are runs of letters (A-Z in lower case, all beyond ASCII).  A language keeps those of ``least`` documents at
    least; a term that is there n times has p = 1 + 10^9 (n + 1) div (N + V), N being the occurrences of all kept terms and
    V their number.  Part ``pair`` has every other source of the language, with the sum of (p - q)^2 div q over all kept
    terms; part ``term`` the kept terms whose p is larger than the whole language's, with that term's share of the sum,
    down to rank ``ranks``.  Ranks go by value, largest first, ties by item in the order of UTF-8.

    Nulls in the three columns count as empty strings, which are a language and a source like others; a language
    without kept terms has pairs of value 0.  A repeated row is a document of its own; texts are read whole, in the memory
    of one task; an empty table gives an empty one; columns besides the three are not read.
    """
    scratch = Scratch(docs.sparkSession, name)
    docs = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = scratch.save(counts(docs, sketch(docs, least, width, size), least, size))
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("nl"), F.sum("docs").alias("d")).where(F.col("d") >= least).select("lang", "term", "nl")
    entries = scratch.save(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "nl"))
    scratch.drop(found)

    langs = entries.select("lang", "term", "nl").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("nl").alias("total_l"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    known = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "own", "v", "total_l")])
    known = scratch.save(known.withColumn("z", F.when(F.col("v") > 0, _p("0L", "total", "v"))))  # z: p of a term that isn't there
    told = scratch.save(entries.join(known, ["lang", "source"]).select("lang", "source", "term", "n", "z", _p("n", "total", "v").alias("p"), _p("nl", "total_l", "v").alias("q")))
    scratch.drop(entries)

    terms_ = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    salted = _ranked(terms_.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SPREAD))), ["_salt"]).where(F.col("rank") <= ranks).drop("rank", "_salt")
    best = _ranked(salted).where(F.col("rank") <= ranks)
    return _ranked(_pairs(told, known)).unionByName(best)


def _ranked(df: DataFrame, more: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part", *more).orderBy(F.desc("value"), "item")))


def _pairs(told: DataFrame, known: DataFrame) -> DataFrame:
    """The distance of every source to each other source of its language, put together from what both have, what one has, and what neither has."""
    g = lambda i: known.select("lang", *[F.col(c).alias(f"{c}{i}") for c in ("source", "own", "v", "z")])
    none = g(1).join(g(2), "lang").where("source1 <> source2")
    none = none.select("lang", "source1", "source2", F.when(F.col("v1") > 0, (F.col("v1") - F.col("own1") - F.col("own2")) * _f("z1", "z2")).otherwise(0).alias("x"))
    # terms of one source, by their count, as if the other didn't have them
    levels = told.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    one = levels.withColumnRenamed("source", "source1").join(g(2).drop("own2", "v2"), "lang").where("source1 <> source2")
    ahead = one.select("lang", "source1", "source2", (F.col("k") * _f("p", "z2")).alias("x"))
    back = one.select("lang", F.col("source2").alias("source1"), F.col("source1").alias("source2"), (F.col("k") * _f("z2", "p")).alias("x"))
    # terms of both: their share, less what they were counted for above (twice as if one didn't have them, and once too often as of neither)
    e = lambda i: told.select("lang", "term", *[F.col(c).alias(f"{c}{i}") for c in ("source", "p", "z")])
    both = e(1).join(e(2), ["lang", "term"]).where("source1 < source2")
    share = lambda a, b: F.sum(_f(f"p{a}", f"p{b}") - _f(f"p{a}", f"z{b}") - _f(f"z{a}", f"p{b}") + _f(f"z{a}", f"z{b}"))
    both = both.groupBy("lang", "source1", "source2").agg(share(1, 2).alias("x12"), share(2, 1).alias("x21"))
    both = both.select("lang", F.explode(F.array(F.struct("source1", "source2", F.col("x12").alias("x")), F.struct(F.col("source2").alias("source1"), F.col("source1").alias("source2"), F.col("x21").alias("x")))).alias("s")).select("lang", "s.*")
    value = none.unionByName(ahead).unionByName(back).unionByName(both).groupBy("lang", "source1", "source2").agg(F.sum("x").alias("value"))
    return value.select("lang", F.col("source1").alias("source"), F.lit("pair").alias("part"), F.col("source2").alias("item"), "value")


# The same in DuckDB's SQL, over documents, with every kept term for every source.
ORACLE = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS nl FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(nl) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.nl + 1)) // (v.total + v.v)::HUGEINT AS ql
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - ql) * (p - ql) // ql)::BIGINT FROM p WHERE n > 0 AND p > ql),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= {RANKS}
"""
