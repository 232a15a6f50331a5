"""Spans of one cell of time, as numpy arrays: which of them hang together, without a list of all pairs that do.

A cell has all spans of a key that reach it, so that any two spans that overlap meet in a cell.  What is
taken from a cell is no more than a row or two for each of its spans, however many pairs of them overlap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Pairs that are compared at once.
BLOCK = 1 << 18


def ratios(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Overlap over the shorter span, -1 where there is none; in doubles, as ``overlap_ratio`` has it."""
    over = np.minimum(hi, hi2) - np.maximum(lo, lo2)
    return np.where(over > 0, over / np.minimum(hi - lo, hi2 - lo2), -1.0)


def joined(lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """A number for each span; spans that overlap by ``least``, directly or through others, have the same.

    Spans that are reached are compared with those that aren't yet, the longest first, so that crowded
    cells are done after a few comparisons and not after all.
    """
    part, left, n = np.full(len(lo), -1), np.arange(len(lo)), 0
    size = hi - lo
    while left.size:
        at = int(np.argmax(size[left]))
        due, left = left[at : at + 1], np.delete(left, at)
        part[due] = n
        while due.size and left.size:
            take = max(1, BLOCK // left.size)
            now, due = due[:take, None], due[take:]
            met = (ratios(lo[now], hi[now], lo[left], hi[left]) >= max(least, 0)).any(axis=0)
            new, left = left[met], left[~met]
            part[new] = n
            due = np.concatenate([new[np.argsort(-size[new], kind="stable")], due])
        n += 1
    return part


def hung(lo: np.ndarray, hi: np.ndarray, kind: np.ndarray, least: float) -> np.ndarray:
    """Kinds of spans (in order of start and id; -1: unspecific) as far as the spans that hold them tell.

    The best link of a span that lies within an earlier starting one is that to the first of those, so an
    unspecific one comes to be of its kind, or of what that one comes to be.
    """
    own = np.arange(len(lo))
    if least > 1:
        return kind
    first = np.searchsorted(np.maximum.accumulate(hi), hi)
    up = np.where((kind < 0) & (lo[first] < lo), first, own)
    while (further := up[up]).tolist() != up.tolist():
        up = further
    return kind[up]


def forest(lo: np.ndarray, hi: np.ndarray, kind: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """The links ``(u, v, ratio)`` by which unspecific spans come to a kind, or to each other, if only spans of this cell count.

    ``v`` has a kind, or is another unspecific one.  Spans with a kind count as one; of any circle of links
    the last in order is not needed, here or among all spans.  A span at a time is added by its best link.
    """
    n, out = len(lo), []
    open_ = np.flatnonzero(kind < 0)
    top, pair, other = np.full(len(open_), -1.0), np.zeros(len(open_), dtype=np.int64), np.full(len(open_), -1)
    reach = np.maximum.accumulate(hi)
    begin, end = np.searchsorted(reach, lo[open_], side="right"), np.searchsorted(lo, hi[open_], side="left")
    for i, u in enumerate(open_):
        near = np.arange(begin[i], end[i])
        near = near[kind[near] >= 0]
        r = ratios(lo[u], hi[u], lo[near], hi[near])
        if r.size and (best := r.max()) >= least and best > 0:
            near = near[r == best]
            both = np.minimum(near, u) * n + np.maximum(near, u)
            at = int(np.argmin(both))
            top[i], pair[i], other[i] = best, both[at], near[at]
    wait = np.ones(len(open_), dtype=bool)
    for _ in range(len(open_)):
        left = np.flatnonzero(wait)
        best = left[top[left] == top[left].max()]
        i = int(best[np.argmin(pair[best])])
        u, wait[i] = open_[i], False
        if other[i] >= 0:
            out.append((int(u), int(other[i]), float(top[i])))
        near = np.arange(np.searchsorted(open_, begin[i]), np.searchsorted(open_, end[i]))
        near = near[wait[near]]
        r = ratios(lo[u], hi[u], lo[open_[near]], hi[open_[near]])
        both = np.minimum(open_[near], u) * n + np.maximum(open_[near], u)
        better = (r >= least) & (r > 0) & ((r > top[near]) | ((r == top[near]) & (both < pair[near])))
        top[near[better]], pair[near[better]], other[near[better]] = r[better], both[better], u
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _kinds(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Kinds as numbers, -1 for none, and what they stand for."""
    coded = table["_kind"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def told(least: float, size: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """For the spans ``(_cell, id, lo, hi, _kind)`` of a cell: unspecific ones with their kind (``ratio`` null), and the links by which the others are told."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lo", "ascending"), ("id", "ascending")])
        ids, lo, hi = (_numbers(table, c) for c in ("id", "lo", "hi"))
        own, names = _kinds(table)
        kind = hung(lo, hi, own, least)
        here = np.flatnonzero((own < 0) & (kind >= 0) & (lo // size == table["_cell"][0].as_py()))
        found = forest(lo, hi, kind, least) if (kind < 0).any() else []
        u, v = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
        a, b = np.minimum(u, v), np.maximum(u, v)
        gone = lambda n: pa.nulls(n, pa.int64())
        code = np.concatenate([kind[here], kind[v]])
        columns = {
            "u": pa.array(np.concatenate([ids[here], ids[u]])), "v": pa.concat_arrays([gone(len(here)), pa.array(ids[v], mask=kind[v] >= 0)]),
            "kind": names.take(pa.array(code, mask=code < 0)), "ratio": pa.concat_arrays([pa.nulls(len(here), pa.float64()), pa.array([f[2] for f in found], pa.float64())]),
        } | {c: pa.concat_arrays([gone(len(here)), pa.array(x)]) for c, x in (("a_lo", lo[a]), ("a", ids[a]), ("b_lo", lo[b]), ("b", ids[b]))}
        return pa.table(columns).select(schema.names).cast(schema)

    return run


def parted(least: float, size: int) -> Callable[[pa.Table], pa.Table]:
    """The spans ``(_cell, id, lo, hi, _kind, ...)`` of a cell with ``_part``, the least id of those of their kind that they hang together with here, ``_first`` (cell of the span) and ``_many`` (cells)."""

    def run(table: pa.Table) -> pa.Table:
        ids, lo, hi = (_numbers(table, c) for c in ("id", "lo", "hi"))
        kind, _ = _kinds(table)
        part = np.empty(len(ids), dtype=np.int64)
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            n = joined(lo[at], hi[at], least)
            low = np.full(n.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, n, ids[at])
            part[at] = low[n]
        begin = lo // size
        out = table.drop_columns(["_cell", "_kind"])
        for name, x in (("_part", part), ("_first", begin == table["_cell"][0].as_py()), ("_many", begin < (hi - 1) // size)):
            out = out.append_column(name, pa.array(x))
        return out

    return run
