"""Shared steps of the operators on vectors: which rows take part, and exact search by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)``: rows with an id whose vector is neither null nor zero and holds finite components only, as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    good = "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    return rows.where(good)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles as a matrix; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def main_width(rows: DataFrame) -> int | None:
    """The commonest length of the vectors (the smaller of equals); others can't be compared with them."""
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return sizes[0].d if sizes else None


def best_of(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact inner products of the ``k`` rows nearest to ``q`` but its own, ties to smaller ids.

    Products are summed the same way for every row, so that equal vectors have equal products.
    """
    rough = x @ q
    rough[ids == own] = -np.inf
    if len(rough) > k:
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= floor - 1e-9 * max(1.0, abs(floor)))
    else:
        at = np.arange(len(rough))
    at = at[np.isfinite(rough[at])]
    exact = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def scan_nearest(query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Task function: (id, vec) to (query, id, score), the ``k`` nearest rows of this task for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.asarray(batch.column(0)), matrix(batch.column(1))
            out = [(np.full(len(i), own), i, s) for own, q in zip(query_ids, queries, strict=True) for i, s in [best_of(ids, x, q, int(own), k)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "id", "score"])

    return run
