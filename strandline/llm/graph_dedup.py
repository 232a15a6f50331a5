"""Near-duplicate vectors by range search on a robust-pruned flat graph.

1.  Equal vectors form a class; one of each goes on.
2.  Each vector is put into the shards of its nearest few centres, so that shards overlap.  A shard with
    too many members gets centres of its own, fitted on a bounded sample of it; what is too large even
    then is cut into overlapping blocks, so that no task holds more than a block.
3.  Each block yields a graph: of the nearest vectors in the block those stay neighbours that no nearer
    neighbour makes redundant.  The neighbour lists of a vector are united over its shards; from here on
    there is one graph over all vectors, and every vector has one home block that keeps its node.
4.  Every vector is searched: greedily from the medoids of the home blocks of its shards, then by
    expanding all nodes near the threshold.  Neighbours of such nodes that live elsewhere go on in the
    next round in their own block, until no search leaves the blocks that it has seen.
5.  Nodes found are verified in double precision on the vectors themselves.
6.  Vectors of a bounded sample are compared with all others until enough that have links are known.
    If the links found fall short, shards overlap more and the search runs again; if they still fall
    short at the largest overlap, all vectors are compared blockwise, which is exact.
7.  Components by alternating large-star and small-star over a spanning forest of each task's links.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .vectors import main_width, matrix, valid_vectors

#: Vectors in a shard on average, centres fitted at once at most, vectors that centres are fitted on at most.
SHARD, CENTRES, SAMPLE = 256, 1000, 16384
#: Vectors of a shard that its own centres are fitted on, and vectors in a block, at most on average.
LOCAL, MOST = 4096, 1024
#: Candidates of a node, neighbours kept, and how much nearer a neighbour must be to make another redundant.
NEAR, DEGREE, ALPHA = 48, 20, 1.2
#: Nodes that a greedy search keeps, how far under the threshold nodes are expanded, nodes expanded at once, entries into another block.
BEAM, SLACK, AT_ONCE, ENTRIES = 12, 0.1, 32, 4
#: Searches that one task runs on a block; more are split.
ASKS = 1024
#: Shards of a vector at first and at most; audited vectors that have links; the share of its links that must be found of one on average.
OVERLAP, OVERLAP_MOST, AUDIT, RECALL = 3, 7, 256, 0.99
#: Vectors in a block on average, and rows compared at once, when all are compared; so many are compared outright if no link is known to audit by.
WHOLE, ROWS, OUTRIGHT = 4096, 256, 1 << 18

_LOG = logging.getLogger(__name__)
_FOUND = "u long, v long, links long, near long"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly drawn rows of ``x``."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where((total != 0).any(1)[:, None], _unit(total), c)
    return c


def _assign(centres: np.ndarray, overlap: int):
    """Task function: (id, vec) to (id, shards): the nearest centres, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                top = _nearest(_unit(matrix(part.column(1))) @ centres.T, overlap)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(top)], names=["id", "shards"])

    return run


def _nearest(s: np.ndarray, m: int) -> np.ndarray:
    """Columns of the ``m`` largest entries of each row, in order."""
    m = min(m, s.shape[1])
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1).astype(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _own_centres(block: pa.Table) -> pa.Table:
    """Group function of a sample of a shard: (shard, number, vec) of its own centres."""
    order = np.argsort(np.asarray(block.column("id")))
    x = _unit(matrix(block.column("vec")))[order]
    c = _centres(x, int(min(CENTRES, len(x), block.column("parts")[0].as_py())))
    shard = block.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard] * len(c), pa.int64()), "number": pa.array(range(len(c)), pa.int64()), "vec": pa.array(c.tolist(), pa.list_(pa.float64()))})


def _own_shards(overlap: int):
    """Group function of some members of a shard and its centres: (id, shard, rank) of the members' shards among them."""

    def run(block: pa.Table) -> pa.Table:
        rank, ids, x = np.asarray(block.column("rank")), np.asarray(block.column("id")), _unit(matrix(block.column("vec")))
        centre = np.flatnonzero(rank < 0)
        centre = centre[np.argsort(ids[centre])]
        rows = np.flatnonzero(rank >= 0)
        top = _nearest(x[rows] @ x[centre].T, overlap)
        place = np.arange(top.shape[1])[None, :] + OVERLAP_MOST * rank[rows][:, None]
        keep = (rank[rows][:, None] == 0) | (np.arange(top.shape[1])[None, :] == 0)
        shard = block.column("shard")[0].as_py() * (CENTRES + 1) + 1 + top
        return pa.table({"id": pa.array(np.broadcast_to(ids[rows][:, None], top.shape)[keep]), "shard": pa.array(shard[keep]), "rank": pa.array(place[keep].astype(np.int64))})

    return run


def prune(s: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours [nodes, degree] of every node, -1 where it has fewer, by similarities ``s`` of all pairs and ``candidates`` [nodes, most].

    The nearest candidate, then the nearest of those that no chosen one makes redundant: that are not
    ``alpha`` times nearer to a chosen one than to the node.
    """
    n = len(s)
    own = np.where(candidates < 0, -np.inf, s[np.arange(n)[:, None], candidates])
    order = np.argsort(-own, axis=1, kind="stable")
    c, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    d = np.sqrt(np.maximum(0, 2 - 2 * own))
    alive = np.isfinite(own)
    out = np.full((n, degree), -1, np.int64)
    for k in range(degree):
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            break
        at = alive[rows].argmax(1)
        best = c[rows, at]
        out[rows, k] = best
        keep = alpha * np.sqrt(np.maximum(0, 2 - 2 * s[best[:, None], c[rows]])) > d[rows]
        keep[np.arange(len(rows)), at] = False
        alive[rows] &= keep
    return out


def _build(block: pa.Table) -> pa.Table:
    """Group function of a block: (id, near) of the graph over its vectors, links in both directions."""
    ids, first = np.unique(np.asarray(block.column("id")), return_index=True)
    x = _unit(matrix(block.column("vec")))[first].astype(np.float32)
    n = len(ids)
    if n == 1:
        return pa.table({"id": pa.array(ids), "near": pa.array([[]], pa.list_(pa.int64()))})
    s = x @ x.T
    np.fill_diagonal(s, -2)
    m = min(NEAR, n - 1)
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    far = np.random.default_rng(n).integers(0, n, (n, 4))  # a few from anywhere keep the graph in one piece
    far[far == np.arange(n)[:, None]] = -1
    out = prune(s, np.where((np.concatenate([near, far], 1)[:, :, None] == near[:, None, :4]).any(2) & (np.arange(m + 4) >= m), -1, np.concatenate([near, far], 1)))
    a, b = np.nonzero(out >= 0)
    to = out[a, b]
    both = np.unique(np.concatenate([a * n + to, to * n + a]))
    a, to = both // n, both % n
    size = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - (np.cumsum(size) - size)[a]
    wide = np.full((n, size.max()), -1, np.int64)
    wide[a, place] = to
    many = np.flatnonzero(size > 2 * DEGREE)  # a node that many point to keeps what isn't redundant
    if len(many):
        less = prune(s, np.where(np.isin(np.arange(n), many)[:, None], wide, -1), 2 * DEGREE)
        wide[many] = -1
        wide[many, : less.shape[1]] = less[many, : wide.shape[1]]
    kept = wide >= 0
    ends = np.concatenate([[0], np.cumsum(kept.sum(1))]).astype(np.int32)
    return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[wide[kept]]))})


def range_search(x: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Similarity [queries, nodes] of the nodes that a search finds, -inf for those it never looks at.

    ``links`` [nodes, most] are neighbours, ``starts`` [queries, some] nodes to start from, -1 where there
    is none.  A greedy search keeps the ``BEAM`` best nodes and expands them; after that every node
    within ``SLACK`` of the threshold is expanded.
    """
    m, n = len(q), len(x)
    sim, done = np.full((m, n), -np.inf, np.float32), np.zeros((m, n), bool)

    def look(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Similarities of nodes [rows, some] not seen before, -inf for the others."""
        new = (nodes >= 0) & np.isneginf(sim[rows[:, None], nodes])
        a, b = np.nonzero(new)
        v = nodes[a, b]
        got = np.full(nodes.shape, -np.inf, np.float32)
        for lo in range(0, len(a), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            got[a[part], b[part]] = np.einsum("ij,ij->i", q[rows[a[part]]], x[v[part]])
        sim[rows[a], v] = got[a, b]
        return got

    every = np.arange(m)
    best = look(every, starts)
    node = starts
    while True:
        if best.shape[1] > BEAM:
            at = np.argpartition(-best, BEAM - 1, axis=1)[:, :BEAM]
            best, node = np.take_along_axis(best, at, 1), np.take_along_axis(node, at, 1)
        open_ = np.where(np.isfinite(best) & ~done[every[:, None], node], best, -np.inf)
        at = open_.argmax(1)
        rows = np.flatnonzero(np.isfinite(open_[every, at]))
        if not len(rows):
            break
        done[rows, node[rows, at[rows]]] = True
        more = np.full((m, links.shape[1]), -1, np.int64)
        more[rows] = links[node[rows, at[rows]]]
        value = np.full(more.shape, -np.inf, np.float32)
        value[rows] = look(rows, more[rows])
        best, node = np.concatenate([best, value], 1), np.concatenate([node, more], 1)
    while True:
        todo = (sim >= threshold - SLACK) & ~done
        todo[np.isfinite(sim).all(1)] = False  # nothing left to find
        rows, nodes = np.nonzero(todo)
        if not len(rows):
            break
        first = np.searchsorted(rows, rows)
        few = np.arange(len(rows)) - first < AT_ONCE
        rows, nodes = rows[few], nodes[few]
        done[rows, nodes] = True
        for lo in range(0, len(rows), 4096):
            a, v = rows[lo : lo + 4096], links[nodes[lo : lo + 4096]]
            seen = (v < 0) | ~np.isneginf(sim[a[:, None], v])
            pair = np.unique((a[:, None] * n + v)[~seen])
            a, v = pair // n, pair % n
            sim[a, v] = np.einsum("ij,ij->i", q[a], x[v])
    return sim


_ROUND = "u long, v long, links long, near long, block long, entries array<long>"


def _search(threshold: float):
    """Group function of a home block and searches in it: counts (u, null, links, near), forest edges (u, v), and (u, block, entries) to go on with.

    ``links`` counts copies, ``near`` doesn't.  A forest edge ties a vector to the least one of its component in this task.
    """

    def run(rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("asks"))
        nodes, queries = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64()), ("near", pa.int64()), ("block", pa.int64()), ("entries", pa.list_(pa.int64()))])
        if not nodes.num_rows or not queries.num_rows:
            return schema.empty_table()
        order = pa.array(np.argsort(np.asarray(nodes.column("id"))))
        nodes = nodes.take(order)
        ids, n, raw = np.asarray(nodes.column("id")), np.asarray(nodes.column("n")), matrix(nodes.column("vec"))
        own, asked = np.asarray(queries.column("id")), matrix(queries.column("vec"))
        x, q = _unit(raw).astype(np.float32), _unit(asked).astype(np.float32)
        # neighbours here, and those that live elsewhere
        near = nodes.column("near").combine_chunks()
        source = np.repeat(np.arange(len(ids)), np.diff(np.asarray(near.offsets)))
        flat = near.flatten()
        to, home = np.asarray(flat.field("id")), np.asarray(flat.field("home"))
        here = home == nodes.column("home")[0].as_py()
        a, v = source[here], np.searchsorted(ids, to[here])
        size = np.bincount(a, minlength=len(ids))
        links = np.full((len(ids), max(1, size.max(initial=0))), -1, np.int64)
        links[a, np.arange(len(a)) - (np.cumsum(size) - size)[a]] = v
        away, away_to, away_home = source[~here], to[~here], home[~here]
        # the medoid of the block in the first round, and the nodes that earlier rounds point to
        entry = queries.column("entries").combine_chunks()
        medoid = int((x @ x.sum(0)).argmax())
        starts = np.full((len(own), ENTRIES + 1), -1, np.int64)
        starts[np.asarray(queries.column("first")), ENTRIES] = medoid
        row = np.repeat(np.arange(len(own)), np.diff(np.asarray(entry.offsets)))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        starts[row, place] = np.searchsorted(ids, np.asarray(entry.flatten()))
        sim = range_search(x, links, starts, q, threshold)
        # verify
        a, b = np.nonzero(sim >= threshold - 1e-4)
        keep = own[a] != ids[b]
        a, b = a[keep], b[keep]
        length, far = np.linalg.norm(raw, axis=1), np.linalg.norm(asked, axis=1)
        cos = np.concatenate([np.einsum("ij,ij->i", asked[a[i : i + 65536]], raw[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) / (far[a] * length[b])
        a, b = a[cos >= threshold], b[cos >= threshold]
        count = np.bincount(a, n[b], len(own)).astype(np.int64)
        plain = np.bincount(a, minlength=len(own))
        has = np.flatnonzero(plain)
        names = np.union1d(ids, own)
        label = forest(np.searchsorted(names, own)[a], np.searchsorted(names, ids)[b], len(names))
        leaf = np.flatnonzero(label != np.arange(len(names)))
        # what nodes near the threshold point to elsewhere
        r, v = np.nonzero(sim >= threshold - SLACK)
        order = np.argsort(away, kind="stable")
        away, away_to, away_home = away[order], away_to[order], away_home[order]
        lo, hi = np.searchsorted(away, v), np.searchsorted(away, v, side="right")
        r = np.repeat(r, hi - lo)
        at = np.repeat(lo, hi - lo) + np.arange(len(r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        going = np.unique(np.stack([r, away_home[at], away_to[at]], 1), axis=0) if len(r) else np.zeros((0, 3), np.int64)
        heads = np.flatnonzero(np.concatenate([[True], (going[1:, :2] != going[:-1, :2]).any(1)])) if len(going) else np.zeros(0, np.int64)
        tails = np.minimum(np.append(heads[1:], len(going)), heads + ENTRIES)
        entries = [going[i:j, 2].tolist() for i, j in zip(heads.tolist(), tails.tolist(), strict=True)]
        sizes = (len(has), len(leaf), len(heads))
        pad = lambda parts: pa.array([x for part, k in zip(parts, sizes, strict=True) for x in (part.tolist() if isinstance(part, np.ndarray) else [part] * k)], pa.int64())
        return pa.table([
            pad((own[has], names[leaf], own[going[heads, 0]])), pad((None, names[label[leaf]], None)), pad((count[has], None, None)), pad((plain[has], None, None)),
            pad((None, None, going[heads, 1])), pa.array([None] * (len(has) + len(leaf)) + entries, pa.list_(pa.int64())),
        ], schema=schema)

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of the component of each of ``n`` nodes under the links (a, b), in which equal ``a`` stand together; ``label`` holds earlier links."""
    label = np.arange(n) if label is None else label
    if not len(a):
        return label
    heads = np.flatnonzero(np.diff(a)) + 1
    for k, to in zip(a[np.append(0, heads)].tolist(), np.split(b, heads), strict=True):
        tied = np.unique(np.append(label[to], label[k]))
        if len(tied) > 1:
            label[np.isin(label, tied)] = tied[0]
    return label


def _compare(threshold: float):
    """Group function of a pair of blocks i and j: (u, null, links, near) counts and (u, v, null, null) forest edges.

    Every vector of i is compared with every one of j.  ``links`` counts copies, ``near`` doesn't.  A forest
    edge ties a vector to the least one of its component in this task.
    """

    def run(block: pa.Table) -> pa.Table:
        ids, first = np.unique(np.asarray(block.column("id")), return_index=True)
        block = block.take(pa.array(first))
        raw, n, own = matrix(block.column("vec")), np.asarray(block.column("n")), np.asarray(block.column("own"))
        i, j = (block.column(c)[0].as_py() for c in ("i", "j"))
        length, x = np.linalg.norm(raw, axis=1), _unit(raw)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, near, label = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for lo in range(0, len(left), ROWS):
            s = x[left[lo : lo + ROWS]] @ x[right].T
            a, b = np.nonzero(s >= threshold - 1e-9)
            cos, a, b = s[a, b], left[lo + a], right[b]
            edge = np.flatnonzero(cos <= threshold + 1e-9)
            cos[edge] = np.einsum("ij,ij->i", raw[a[edge]], raw[b[edge]]) / (length[a[edge]] * length[b[edge]])
            keep = (cos >= threshold) & ((a < b) | (i != j))
            a, b = a[keep], b[keep]
            links += np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
            near += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            label = forest(a, b, len(ids), label)
        has, leaf = np.flatnonzero(near), np.flatnonzero(label != np.arange(len(ids)))
        u, v = np.concatenate([ids[has], ids[leaf]]), [None] * len(has) + ids[label[leaf]].tolist()
        counts = [x[has].astype(np.int64).tolist() + [None] * len(leaf) for x in (links, near)]
        return pa.table([pa.array(c, pa.int64()) for c in (u, v, *counts)], names=["u", "v", "links", "near"])

    return run


def _count_near(ids: np.ndarray, x: np.ndarray, threshold: float):
    """Task function: (id, n, vec) to (query, near), the vectors of this task that a few vectors have links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(ids), np.int64), max(64, (1 << 21) // len(ids))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                own = np.asarray(part.column(0))
                total += ((x @ _unit(matrix(part.column(2))).T >= threshold) & (ids[:, None] != own[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["query", "near"])

    return run


def _known_links(one: DataFrame, sample_ids: np.ndarray, x: np.ndarray, threshold: float) -> dict[int, int]:
    """Links, by comparison with all vectors, of those of the sample that have any: of ``AUDIT`` at least, if the whole sample has so many."""
    known: dict[int, int] = {}
    at, step = 0, AUDIT
    while at < len(sample_ids) and len(known) < AUDIT:
        task = _count_near(sample_ids[at : at + step], x[at : at + step], threshold)
        counted = one.mapInArrow(task, "query long, near long").groupBy("query").agg(F.sum("near").alias("near")).where("near > 0")
        known |= {r["query"]: r.near for r in counted.collect()}
        at, step = at + step, min(2 * step, 2048)
    return known


def _audit_found(one: DataFrame, counts: DataFrame, threshold: float) -> dict[int, int]:
    """Links, by comparison with all vectors, of some that the search found links of: ``AUDIT`` at most, the first by a hash."""
    drawn = counts.orderBy(F.xxhash64("u")).limit(AUDIT).select(F.col("u").alias("id"))
    rows = one.join(F.broadcast(drawn), "id").select("id", "vec").collect()
    return _known_links(one, np.array([r.id for r in rows], np.int64), _unit(np.array([r.vec for r in rows])), threshold) if rows else {}


def recalls(known: dict[int, int], got: dict[int, int]) -> dict[str, float]:
    """Share of its links found of an audited vector on average: of all, and of those with 1-9, 10-99, ... links, so that large groups don't outweigh pairs."""
    classes: dict[str, list[float]] = {}
    for i, n in known.items():
        share, low = min(got.get(i, 0), n) / n, 10 ** (len(str(n)) - 1)
        for c in ("all", f"{low}-{10 * low - 1}"):
            classes.setdefault(c, []).append(share)
    return {c: float(np.mean(v)) for c, v in classes.items()}


def _shards(one: DataFrame, centres: np.ndarray, overlap: int, scratch: Scratch) -> DataFrame:
    """``(id, shard, rank)``: the shards of each vector, its home at rank 0; shards beyond ``MOST`` members are divided by centres of their own."""
    told = one.select("id", "vec").mapInArrow(_assign(centres, overlap), "id long, shards array<long>")
    flat = scratch.save(told.select("id", F.posexplode("shards").alias("rank", "shard")).select("id", "shard", F.col("rank").cast("long").alias("rank")))
    sizes = flat.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST)
    large = scratch.save(sizes.select("shard", "n", F.ceil(F.col("n") / SHARD).alias("parts")))  # a row for each of at most CENTRES shards
    rest = flat.join(F.broadcast(large.select("shard")), "shard", "left_anti").select("id", (F.col("shard") * (CENTRES + 1)).alias("shard"), (F.col("rank") * OVERLAP_MOST).alias("rank"))
    members = scratch.save(flat.join(F.broadcast(large), "shard").join(one.select("id", "vec"), "id"))
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(0.9 * LOCAL) / F.col("n")) * (1 << 20)
    own = scratch.save(members.where(drawn).select("shard", "id", "vec", "parts").groupBy("shard").applyInArrow(_own_centres, "shard long, number long, vec array<double>"))
    salts = F.ceil(F.col("n") / (8 * MOST)).cast("long")
    asked = members.select("shard", F.pmod(F.xxhash64("id"), salts).alias("salt"), "id", "vec", "rank")
    heads = own.join(F.broadcast(large), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("number").alias("id"), "vec", F.lit(-1).cast("long").alias("rank"))
    divided = asked.union(heads).groupBy("shard", "salt").applyInArrow(_own_shards(overlap), "id long, shard long, rank long")
    return scratch.save(rest.union(divided))


def _link(one: DataFrame, centres: np.ndarray, overlap: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v, links, near) of the searches of all vectors in the graph that the given overlap of shards makes."""
    placed = _shards(one, centres, overlap, scratch)
    sizes = scratch.save(placed.groupBy("shard").agg(F.ceil(F.count("*") / MOST).cast("long").alias("parts")))
    placed = placed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id", "shard"), "parts"))
    # a shard in parts becomes a ring of blocks that share members
    into = F.array_distinct(F.array("part", F.pmod(F.col("part") + 1, "parts")))
    spread = placed.select("id", "shard", F.explode(into).alias("part"), F.lit(False).alias("own"))
    # once more over the nodes of each home block alone, so that every one is reached from the others there
    spread = spread.union(placed.where("rank = 0").select("id", "shard", "part", F.lit(True))).join(one.select("id", "vec"), "id")
    edges = spread.groupBy("shard", "part", "own").applyInArrow(_build, "id long, near array<long>").select("id", F.explode("near").alias("to")).distinct()
    block = F.col("shard") * (1 << 20) + F.col("part")
    home = scratch.save(placed.where("rank = 0").select("id", block.alias("home"), "shard"))
    near = edges.join(home.select(F.col("id").alias("to"), "home"), "to").groupBy("id").agg(F.collect_list(F.struct(F.col("to").alias("id"), "home")).alias("near"))
    empty = F.array().cast("array<struct<id:long,home:long>>")
    nodes = one.join(home.select("id", "home"), "id").join(near, "id", "left")
    nodes = scratch.save(nodes.select("home", "id", "n", "vec", F.coalesce("near", empty).alias("near")))

    # first all home blocks of a vector's shards, from their medoids and from its own node
    blocks = home.select("shard", "home").distinct()
    none = F.array().cast("array<long>")
    own = F.when(F.col("home") == F.col("own"), F.array("id")).otherwise(none)
    goals = placed.select("id", "shard").join(blocks, "shard").select("id", "home").distinct().join(home.select("id", F.col("home").alias("own")), "id")
    goals = scratch.save(goals.select("id", "home", own.alias("entries")))
    seen, first, found = goals.select("id", "home"), True, []
    while True:
        asks = goals.join(one.select("id", "vec"), "id")
        parts = scratch.save(goals.groupBy("home").agg(F.ceil(F.count("*") / ASKS).cast("long").alias("parts")))
        held = nodes.join(parts, "home").select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "n", "vec", "near", none.alias("entries"), F.lit(False).alias("first"), F.lit(False).alias("asks"))
        asks = asks.join(parts, "home").select("home", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", F.lit(1).cast("long").alias("n"), "vec", empty.alias("near"), "entries", F.lit(first).alias("first"), F.lit(True).alias("asks"))
        told = scratch.save(held.union(asks).groupBy("home", "part").applyInArrow(_search(threshold), _ROUND))
        found.append(told.where("block is null").select("u", "v", "links", "near"))
        goals = told.where("block is not null").groupBy(F.col("u").alias("id"), F.col("block").alias("home")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entries")))), 1, ENTRIES).alias("entries"))
        goals = scratch.save(goals.join(seen, ["id", "home"], "left_anti"))
        if goals.isEmpty():
            return scratch.save(reduce(DataFrame.union, found))
        seen, first = scratch.save(seen.union(goals.select("id", "home"))), False


def _link_all(one: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """As ``_link``, with every vector compared with every other of its length: exact, in time that grows with the square of their number."""
    sizes = scratch.save(one.groupBy(F.size("vec").cast("long").alias("shard")).agg(F.ceil(F.count("*") / WHOLE).cast("long").alias("blocks")))
    spread = one.withColumn("shard", F.size("vec").cast("long")).join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "vec")
    return scratch.save(spread.groupBy("shard", "i", "j").applyInArrow(_compare(threshold), _FOUND))


def near_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", name: str = "vectors", report: dict | None = None, whole: bool = False) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every id of ``df``.

    Vectors that are null, zero, or hold null or non-finite components are linked with nothing; vectors
    of another length than most are compared with those of their own length, all with all.  Rows
    repeating an id count once, with the least of their vectors; rows without an id are left out; an
    empty table gives an empty one; other columns are ignored.
    Ids must be whole numbers, and are cast to long.
    The recall measured at each overlap is logged and put into ``report``: ``audited`` vectors, ``recall``
    as (overlap, ``recalls``), and whether the links are those of all pairs (``exact``).  Where no sampled vector
    has a link, vectors that the search linked are audited instead; where it linked none either, up to
    ``OUTRIGHT`` vectors are compared all with all, and beyond that the recall is reported as ``unmeasured``;
    with ``whole`` they are compared whatever their number, so that no result depends on it.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, name)
    all_ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    rows = valid_vectors(df, id_col, vec_col)
    width = main_width(rows)
    if width is None:
        return all_ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    rows = scratch.save(rows.groupBy("id").agg(F.min("vec").alias("vec")))
    every = scratch.save(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "vec"))
    member = rows.join(every.where("n > 1").select(F.col("id").alias("rep"), "vec"), "vec").select("id", "rep")
    member = scratch.save(member)
    one, others = every.where(F.size("vec") == width), every.where(F.size("vec") != width)

    count = one.count()
    k = max(1, min(CENTRES, count // SHARD))
    drawn = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, 0.9 * SAMPLE / count) * (1 << 30)) if count > SAMPLE else one
    sample = drawn.orderBy(F.xxhash64("id", F.lit(1))).limit(SAMPLE).select("id", "n", "vec").collect()
    x = _unit(np.array([r.vec for r in sample]))
    centres = _centres(x, min(k, len(x)))
    known = _known_links(one, np.array([r.id for r in sample], np.int64), x, threshold)
    report = {} if report is None else report
    report.update(audited=len(known), recall=[], exact=False)
    overlap = OVERLAP
    while True:
        found = _link_all(one, threshold, scratch) if report["exact"] else _link(one, centres, overlap, threshold, scratch)
        counts = scratch.save(found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"), F.sum("near").alias("near")))
        if not known and not report["exact"]:
            known = _audit_found(one, counts, threshold)
            report.update(audited=len(known))
        got = {r.u: r.near for r in counts.where(F.col("u").isin(list(known))).collect()} if known else {}
        measured = recalls(known, got)
        report["recall"].append(("all pairs" if report["exact"] else overlap, measured or "unmeasured"))
        _LOG.info("recall of %d audited vectors, overlap %s: %s", len(known), *report["recall"][-1])
        if not measured and not report["exact"]:
            if count > OUTRIGHT and not whole:
                _LOG.warning("no link among %d vectors to measure the recall by", count)
                break
            report["exact"] = True
            continue
        if report["exact"] or min(measured.values()) >= RECALL:
            break
        report["exact"] = overlap >= min(OVERLAP_MOST, len(centres))
        overlap += 2
    if not others.isEmpty():
        more = _link_all(others, threshold, scratch)
        found = found.union(more)
        counts = counts.union(more.where("v is null").groupBy("u").agg(F.sum("links").alias("links"), F.sum("near").alias("near")))
    links = counts.select("u", "links")
    tied = scratch.save(components(found.where("v is not null").select("u", "v"), scratch))
    out = all_ids.join(member, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(links.withColumnRenamed("u", "rep"), "rep", "left").join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.join(every.where("n > 1").select(F.col("id").alias("rep"), "n"), "rep", "left")
    group = F.coalesce("component", "rep")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1
    return out.select(F.col("id").alias(id_col), n_links.cast("long").alias("n_links"), group.alias("component_id"), (F.col("id") == group).alias("kept"))
