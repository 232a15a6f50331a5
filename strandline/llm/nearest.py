"""Approximate nearest neighbours by cross-polytope hashing.

Fast pseudo-rotations (three rounds of random signs and a Hadamard transform) turn a unit vector; its
cell is the signed axis with the largest coordinate.  A table concatenates as many such hashes as the
number of rows asks for; there are several tables.  A query probes, in each table, the cells that its
own coordinates rank first; all rows of a probed cell are candidates and are ranked by their exact
inner product.  How many cells to probe, of how many tables, is read from audited queries whose nearest
rows are known, and checked on others; where no number of tables reaches the recall, every query is
compared with all rows, block by block.

For vectors of unequal length the largest inner product becomes the largest cosine by one more
coordinate that fills every row up to the longest.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import best_of, main_width, matrix, scan_nearest, valid_vectors

#: Tables at first and at most.
TABLES, TABLES_MOST = 4, 16
#: Audited queries at most, the share of their nearest rows that the probed cells must hold, and the least share on those audited queries that the number wasn't read from.
AUDIT, RECALL, LEAST = 192, 0.96, 0.94
#: Rows of a cell that one task compares with its queries; larger cells are split.  Rows in a block when all are compared.
BLOCK, WHOLE = 512, 4096
_LOG = logging.getLogger(__name__)
#: Queries that one task compares with a block; more are split.
ASKS = 1024
#: A table gets one more hash when its cells would hold more rows than this on average.
CELL = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep lengths; their width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass
class Hasher:
    """Signs of every rotation; ``longest`` is the length that rows are filled up to (0: they are all of one length)."""

    width: int
    longest: float
    hashes: int
    tables: int = TABLES
    seed: int = 11

    @property
    def padded(self) -> int:
        return 1 << (self.width + (self.longest > 0) - 1).bit_length() if self.width + (self.longest > 0) > 1 else 1

    def turned(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Coordinates [tables, hashes, rows, padded] after each rotation."""
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        unit = np.zeros((len(x), self.padded))
        if query or not self.longest:
            unit[:, : self.width] = x / norm
        else:
            unit[:, : self.width] = x / self.longest
            unit[:, self.width] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.hashes, 3, self.padded))
        out = np.empty((self.tables, self.hashes, len(x), self.padded))
        for t in range(self.tables):
            for h in range(self.hashes):
                y = unit
                for s in signs[t, h]:
                    y = hadamard(y * s)
                out[t, h] = y
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row in each table [tables, rows]."""
        out = np.zeros((self.tables, len(x)), np.int64)
        for c in np.moveaxis(self.turned(x, False), 1, 0):
            axis = np.abs(c).argmax(2)
            sign = np.take_along_axis(c, axis[:, :, None], 2)[:, :, 0] < 0
            out = out * (2 * self.padded) + 2 * axis + sign
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` cells that each query ranks first in each table [tables, rows, count], best first."""
        wide = 2 * self.padded
        best = sums = None
        for c in np.moveaxis(self.turned(x, True), 1, 0):
            both = np.stack([c, -c], axis=3).reshape(*c.shape[:2], wide)
            top = np.argsort(-both, axis=2, kind="stable")[:, :, :count]
            value = np.take_along_axis(both, top, 2)
            if best is None:
                best, sums = top, value
                continue
            total = (sums[:, :, :, None] + value[:, :, None, :]).reshape(*c.shape[:2], -1)
            code = (best[:, :, :, None] * wide + top[:, :, None, :]).reshape(*c.shape[:2], -1)
            keep = np.argsort(-total, axis=2, kind="stable")[:, :, :count]
            best, sums = np.take_along_axis(code, keep, 2), np.take_along_axis(total, keep, 2)
        return best


def _index(hasher: Hasher):
    """Task function: (id, vec) to (tab, cell, id, vec), one row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                for t, c in enumerate(hasher.cells(matrix(part.column(1)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int64)), pa.array(c), part.column(0), part.column(1)], names=["tab", "cell", "id", "vec"])

    return run


def _probe(hasher: Hasher, count: int):
    """Task function: (id, vec) to (tab, cell, id, vec) for the cells that a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for t, c in enumerate(hasher.probes(matrix(part.column(1)), count)):
                    at = pa.array(np.repeat(np.arange(len(c)), c.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c.size, t, np.int64)), pa.array(c.ravel()), part.column(0).take(at), part.column(1).take(at)], names=["tab", "cell", "id", "vec"])

    return run


def _rank(k: int):
    """Group function of one block of a cell and the queries that probe it: the ``k`` nearest rows of the block for each query."""

    def run(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks"))
        ids, x = np.asarray(block.column("id")), matrix(block.column("vec"))
        own, rows = ids[~asks], x[~asks]
        out = [(np.full(len(i), q), i, s) for q, v in zip(ids[asks], x[asks], strict=True) for i, s in [best_of(own, rows, v, int(q), k)]] if len(own) else []
        query, found, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(query, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


_FOUND = "query long, id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked from 1, ties to smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.dropDuplicates(["query", "id"]).withColumn("rank", rank).where(F.col("rank") <= k)


def _exact(rows: DataFrame, ask: list, k: int) -> DataFrame:
    """The ``k`` nearest rows of a few queries by a scan of all rows."""
    ids, vecs = np.array([r.id for r in ask], np.int64), np.array([r.vec for r in ask])
    return _top(rows.select("id", "vec").mapInArrow(scan_nearest(ids, vecs, k), _FOUND), k)


def _places(hasher: Hasher, ask: list, truth: list) -> np.ndarray:
    """For every known nearest row of ``truth`` the place of its cell among those that its query probes in a table, the first of all tables; -1 if it is among none."""
    most = 2 * hasher.padded if hasher.hashes == 1 else 4 * hasher.padded
    vecs = {r.id: r.vec for r in ask}
    near = {r.id: r.vec for r in truth}
    order = dict(zip(vecs, np.moveaxis(hasher.probes(np.array(list(vecs.values())), most), 1, 0), strict=True))
    cell = dict(zip(near, hasher.cells(np.array(list(near.values()))).T, strict=True))
    first = []
    for r in truth:
        hit = order[r.query] == cell[r.id][:, None]
        first.append(min((int(h.argmax()) for h in hit if h.any()), default=-1))
    return np.array(first)


def probes_needed(places: np.ndarray, fits: np.ndarray, recall: float, report: dict) -> int | None:
    """Least number of cells per table that hold ``recall`` of the rows that ``fits`` marks, and ``LEAST`` of the others; none if there is no such number."""
    at = np.where(places < 0, 1 << 40, places)
    count = None
    for part, share in ((fits, recall), (~fits, min(recall, LEAST))):
        if part.any():
            need = int(np.sort(at[part])[int(np.ceil(share * part.sum())) - 1])
            if need >= 1 << 40:
                return None
            count = max(count or 1, need + 1)
    report["recall"] = tuple(float((at[p] < count).mean()) if p.any() else None for p in (fits, ~fits))
    return count


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, name: str = "nearest", cell: int = CELL, report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``df`` with the largest inner product for each row of ``queries`` but itself.

    A query whose probed cells hold too few rows is compared with all rows.  Vectors that are null, zero
    or hold null or non-finite components take no part; those of another length than most are compared
    with all of their own length.  Rows repeating an id count once, with the least of their vectors; of
    equal scores the smaller id is nearer; an empty table gives an empty one; other columns are ignored.
    Every row is indexed; up to ``AUDIT`` queries, drawn by a hash of their id, are answered exactly:
    two thirds of them choose how many cells of how many tables are probed, so that ``recall`` of their
    answers is among them, and the others check it.  If ``TABLES_MOST`` tables don't hold it, all
    queries are compared with all rows.  What was measured is logged and put into ``report``: ``tables``,
    ``probes`` (none: all rows), ``recall`` on the two parts of the audited queries.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, name)
    rows = valid_vectors(df, id_col, vec_col)
    width = main_width(rows)
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = lambda df: scratch.save(df.groupBy("id").agg(F.min("vec").alias("vec")))
    rows, asked = once(rows), once(valid_vectors(queries, id_col, vec_col))
    others, odd = rows.where(F.size("vec") != width), asked.where(F.size("vec") != width)
    rows, asked = rows.where(F.size("vec") == width), asked.where(F.size("vec") == width)
    report = {} if report is None else report
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("high"), F.min(norm).alias("low")).first()
    level = stats.low is not None and stats.high - stats.low <= 1e-5 * stats.high
    hasher = Hasher(width, 0.0 if level or stats.high is None else float(stats.high) * (1 + 1e-12), 1, tables)
    while stats.n > cell * (2 * hasher.padded) ** hasher.hashes:
        hasher.hashes += 1
    ask = asked.orderBy(F.xxhash64("id")).limit(AUDIT).collect()
    if not ask or stats.n < 2:
        best = spark.createDataFrame([], "query long, id long, score double, rank int")
    else:
        truth = _exact(rows, ask, k).join(rows, "id").select("query", "id", "vec").collect()
        third = {r.id for r in ask[2::3]}
        fits = np.array([r.query not in third for r in truth], bool)
        count = probes_needed(_places(hasher, ask, truth), fits, recall, report) if truth else 1
        while count is None and hasher.tables < TABLES_MOST:
            hasher.tables = min(2 * hasher.tables, TABLES_MOST)
            count = probes_needed(_places(hasher, ask, truth), fits, recall, report)
        report.update(tables=hasher.tables, probes=count, hashes=hasher.hashes)
        _LOG.info("nearest: %s", report)
        best = _scan(rows, asked, k, scratch) if count is None else _probed(rows, asked, stats.n, k, hasher, count, scratch)
    if not odd.isEmpty():
        best = best.select("query", "id", "score", "rank").union(_scan(others, odd, k, scratch).select("query", "id", "score", "rank"))
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _scan(rows: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The ``k`` nearest of all rows of its length for each of ``asked``: blocks of rows meet parts of the queries."""
    told = lambda df, per, out: df.groupBy(F.size("vec").alias("cell")).agg(F.ceil(F.count("*") / per).cast("long").alias(out))
    cells = scratch.save(told(rows, WHOLE, "blocks").join(told(asked, ASKS, "parts"), "cell"))
    return scratch.save(_top(_meet(rows.withColumn("cell", F.size("vec")), asked.withColumn("cell", F.size("vec")), ["cell"], cells).applyInArrow(_rank(k), _FOUND), k))


def _meet(held: DataFrame, asks: DataFrame, keys: list[str], cells: DataFrame):
    """Groups of one block of the rows and one part of the queries of a cell; ``cells(keys, blocks, parts)``."""
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = held.join(cells, keys).select(*keys, F.pmod(F.xxhash64("id"), "blocks").alias("block"), upto("parts").alias("part"), "id", "vec", F.lit(False).alias("asks"))
    asks = asks.join(cells, keys).select(*keys, upto("blocks").alias("block"), F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "vec", F.lit(True).alias("asks"))
    return held.union(asks).groupBy(*keys, "block", "part")


def _probed(rows: DataFrame, asked: DataFrame, n: int, k: int, hasher: Hasher, count: int, scratch: Scratch) -> DataFrame:
    """The ``k`` nearest rows in ``count`` cells of each table, or in all rows for a query whose cells hold too few."""
    index = scratch.save(rows.mapInArrow(_index(hasher), "tab long, cell long, id long, vec array<double>"))
    cells = scratch.save(index.groupBy("tab", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))
    probes = scratch.save(asked.mapInArrow(_probe(hasher, count), "tab long, cell long, id long, vec array<double>"))
    parts = probes.groupBy("tab", "cell").agg(F.ceil(F.count("*") / ASKS).cast("long").alias("parts"))
    cells = scratch.save(cells.join(parts, ["tab", "cell"]))  # the others are asked for nothing
    found = _meet(index, probes, ["tab", "cell"], cells).applyInArrow(_rank(k), _FOUND)
    best = scratch.save(_top(found, k))

    want = F.least(F.lit(k), F.lit(n) - F.coalesce("inside", F.lit(0)))
    inside = rows.select("id", F.lit(1).alias("inside"))
    got = best.groupBy("query").agg(F.count("*").alias("n"))
    short = asked.join(inside, "id", "left").join(got, asked["id"] == got["query"], "left").where(F.coalesce("n", F.lit(0)) < want).select(asked["id"], "vec")
    short = scratch.save(short)
    if not short.isEmpty():
        more = _scan(rows, short, k, scratch)
        best = best.join(more.select("query").distinct(), "query", "left_anti").unionByName(more)
    return best
