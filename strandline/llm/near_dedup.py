"""MinHash near-duplicate detection with exact confirmation on whole shingle sets.

1.  One pass over the texts gives each document the size of its shingle set, a 128-bit print of the
    set, and band keys over many universal hash minima.
2.  Documents with equal sets form a class, represented by its least id; only representatives go on.
3.  Within each band bucket the signatures are compared, and those that agree well enough for a link are
    tied together; of the ties of a task a spanning forest is kept.  A large bucket is cut into blocks, each
    compared within itself and with a few hubs of the bucket; then only members that are not in the
    bucket's largest component are compared with the other blocks, and with other components alone.
    Components of the ties are the families.  A linked pair shares a bucket and agrees there, so no link
    leaves a family, and documents that share a bucket by chance don't chain families together.
4.  A family is cut into blocks likewise: signatures rule most pairs out, the full sets confirm the rest,
    and a task returns a forest that spans its links.  A set goes to its own block once, those of the hubs to
    every block; members outside the family's largest component meet the other blocks afterwards.
    Pairs are never rows of a table; a family of any size spreads over many tasks, and one whose members
    are all alike is compared in time that grows with their number, not with its square.
5.  Components of the links by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textkit import groups, lean, mix64, shingles, sorted_overlap, text_bytes, word_hashes, word_spans

BANDS, ROWS = 25, 5
_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_STEP = 512
#: Agreement of signatures under which a pair is not compared in full: more than five standard errors under a similarity of 0.8.
_SLACK = 0.2
#: A family has blocks of ``BLOCK`` members, and a block sets of ``HASHES`` shingles on average at most; hubs of a bucket and of a family.
BLOCK, HASHES, HUBS = 256, 1 << 23, 8
#: Members of a bucket that are compared in one piece, and rows of small buckets that one task takes at once on average.
BUCKET, ROWS_AT_ONCE = 1024, 16384


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of ``a * x + b mod 2**32`` over a set, for each of the hash functions."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    buf = np.empty((len(_A), min(_STEP, max(len(x), 1))), np.uint32)
    for i in range(0, len(x), _STEP):
        part = x[None, i : i + _STEP]
        out = buf[:, : part.shape[1]]
        np.multiply(_A, part, out=out)
        out += _B
        np.minimum(low, out.min(1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the signature."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sig.reshape(BANDS, ROWS).T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    return h.view(np.int64)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text of a batch (id, text)."""
    data, off, _ = text_bytes(batch.column(1))
    for lo, hi in groups(off):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        for i in range(hi - lo):
            yield lo + i, shingles(words[first[i] : first[i + 1]], size)


def _describe(size: int):
    """Task function: (id, text) to (id, n, print, bands, low bytes of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            fp = np.zeros((2, batch.num_rows), np.int64)
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            signs = np.zeros((batch.num_rows, BANDS * ROWS), np.uint8)
            for i, s in _sets(batch, size):
                n[i] = len(s)
                if len(s):
                    fp[0, i] = np.bitwise_xor.reduce(mix64(s)).view(np.int64)
                    fp[1, i] = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).view(np.int64)
                    sig = signature(s)
                    bands[i], signs[i] = band_keys(sig), sig.astype(np.uint8)
            empty = n == 0
            ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(fp[0], mask=empty), pa.array(fp[1], mask=empty), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[~empty].ravel())), pa.array([x.tobytes() for x in signs], pa.binary())],
                names=["id", "n", "fp1", "fp2", "bands", "signs"],
            )

    return run


def _plausible(percent: int):
    """Group function of whole buckets, or of two sides of one (``own`` tells them apart): a forest (u, v) of the pairs whose sizes and signatures allow a link.

    Members of one ``label`` (of an earlier round) are tied already.
    """
    least = (percent / 100 - _SLACK) * BANDS * ROWS

    def run(rows: pa.Table) -> pa.Table:
        key, ids, own, n = (np.asarray(rows.column(c)) for c in ("key", "id", "own", "n"))
        order = np.lexsort((ids, own, key))
        key, ids, own, n = key[order], ids[order], own[order], n[order]
        signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        tied_before = np.asarray(rows.column("label"))[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        u, v = [], []

        def near(a, b):
            fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            return fits & ((signs[a] == signs[b]).sum(1) >= least)

        two = heads[sizes == 2]
        two = two[near(two, two + 1)]
        u.append(ids[two])
        v.append(ids[two + 1])
        for lo, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            at = np.arange(lo, lo + size)
            left, right = (at, at) if own[lo] == own[lo + size - 1] else (at[own[at] == own[lo]], at[own[at] != own[lo]])
            label = np.unique(tied_before[lo : lo + size], return_inverse=True)[1]
            for a in left.tolist():
                rest = right[(right > a) & (label[right - lo] != label[a - lo])]
                if not len(rest):
                    continue
                rest = rest[near(np.full(len(rest), a), rest)]
                if len(rest):
                    tied, first = np.unique(label[rest - lo], return_index=True)
                    u.append(np.full(len(tied), ids[a]))
                    v.append(ids[rest[first]])
                    label[np.isin(label, tied)] = label[a - lo]
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    return run


def _families(told: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(id, family)`` of documents that may have a link."""
    bands = told.select("id", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    sizes = scratch.save(sizes.select("key", F.ceil(F.col("members") / BUCKET).cast("long").alias("blocks"), "members"))
    total = sizes.agg(F.sum("members")).first()[0] or 0
    # signatures join what is left of the buckets, which is little: they aren't sent through the join of all bands
    shared = scratch.save(bands.join(sizes.select("key", "blocks"), "key"))
    rows = shared.join(told.select("id", "n", "signs"), "id")
    columns = ["key", "i", "own", "id", "label", "n", "signs"]
    none = F.lit(0).cast("long")
    at_once = F.lit(max(1, -(-total // ROWS_AT_ONCE)))
    small = rows.where("blocks = 1").select("key", F.pmod(F.xxhash64("key"), at_once).alias("i"), none.alias("own"), "id", F.col("id").alias("label"), "n", "signs")
    ties = small.groupBy("i").applyInArrow(_plausible(percent), "u long, v long")
    if sizes.where("blocks > 1").isEmpty():
        return scratch.save(components(ties, scratch).withColumnsRenamed({"node": "id", "component": "family"}))

    large = scratch.save(rows.where("blocks > 1").withColumn("i", F.pmod(F.xxhash64("id"), "blocks")))
    hubs = _first_of(large.select("key", "id"), "key", "id").join(sizes.select("key", "blocks"), "key").join(told.select("id", "n", "signs"), "id")
    hubs = hubs.select("key", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("i"), F.lit(-1).cast("long").alias("own"), "id", F.col("id").alias("label"), "n", "signs")
    block = large.select("key", "i", none.alias("own"), "id", F.col("id").alias("label"), "n", "signs")
    near_hubs = scratch.save(block.union(hubs).groupBy("key", "i").applyInArrow(_plausible(percent), "u long, v long"))
    ties = ties.union(block.groupBy("key", "i").applyInArrow(_plausible(percent), "u long, v long")).union(near_hubs)
    labelled = scratch.save(_labelled(large.select("key", "i", "id", "n", "signs"), near_hubs, hubs.select("id").distinct()))
    rest, other = _leftovers(labelled, "key", BUCKET, scratch)
    if rest is not None:
        sides = rest.select("key", "i", "other", F.lit(-1).cast("long").alias("own"), "id", "label", "n", "signs").union(other.select("key", "i", "other", none.alias("own"), "id", "label", "n", "signs"))
        ties = ties.union(sides.groupBy("key", "i", "other").applyInArrow(_plausible(percent), "u long, v long"))
    return scratch.save(components(ties, scratch).withColumnsRenamed({"node": "id", "component": "family"}))


def _labelled(members: DataFrame, ties: DataFrame, hubs: DataFrame) -> DataFrame:
    """``members`` with ``label``: the least hub that a member is tied to itself, else its own id.

    Members of one label are tied to the same hub.  Two labels may be of one component: their members are
    compared once more, which costs time and changes nothing.
    """
    own = ties.join(hubs.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("label"))
    own = own.union(hubs.select("id", F.col("id").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
    return members.join(own, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _first_of(rows: DataFrame, group: str, item: str) -> DataFrame:
    """``(group, item)``: ``HUBS`` items of each group, the first by a hash; every task keeps no more than that of a group."""
    order = F.struct(F.xxhash64(item, F.lit(7)).alias("h"), F.col(item).alias(item))
    salted = rows.groupBy(group, F.pmod(F.xxhash64(item), F.lit(64)).alias("_salt")).agg(F.min(order).alias("o"))
    best = salted.groupBy(group).agg(F.slice(F.array_sort(F.collect_list("o")), 1, HUBS).alias("o"))
    return best.select(group, F.explode(f"o.{item}").alias(item))


def _leftovers(labelled: DataFrame, group: str, size: int, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Members outside the largest component of their group, and all members, each side once for every block ``(i, other)`` of the other; None if there are none.

    ``labelled(group, i, id, label, ...)``: block of each member and the component that it is in so far.
    """
    counts = scratch.save(labelled.groupBy(group, "label").agg(F.count("*").alias("k")))
    top = counts.groupBy(group).agg(F.max_by("label", F.struct("k", "label")).alias("top"), (F.sum("k") - F.max("k")).alias("left")).where(F.col("left") > 0)
    top = scratch.save(top.select(group, "top", F.ceil(F.col("left") / size).cast("long").alias("parts")))
    if top.isEmpty():
        return None, None
    blocks = labelled.groupBy(group).agg((F.max("i") + 1).alias("blocks"))
    met = labelled.join(top.join(blocks, group), group)
    rest = met.where("label <> top").withColumn("other", F.pmod(F.xxhash64("id", F.lit(3)), "parts")).drop("i").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rest, every


_SET_NAMES = ["id", "family", "i", "other", "own", "label", "set"]


def _full_sets(size: int):
    """Task function: (id, text, family, label, places) to (id, family, i, other, own, label, set): the set once for each place (i, other, own) of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            ids, family, label, places = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            for i, s in _sets(batch, size):
                raw = s.tobytes()
                for p in places[i]:
                    rows.append((ids[i], family[i], p["i"], p["other"], p["own"], label[i], raw))
                    held += len(raw)
                    if held > 4 << 20:
                        yield _set_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_SET_NAMES)


def _confirm(percent: int):
    """Task function of a block with hubs (``own`` -1 or 0, all compared) or of leftovers and a block (-2 and 0, compared with each other): a forest (u, v) that spans the links.

    Members of one ``label`` are linked already.
    """

    def run(block: pa.Table) -> pa.Table:
        ids, own, label = (np.asarray(block.column(c)) for c in ("id", "own", "label"))
        order = np.lexsort((ids, own))
        ids, own, label = ids[order], own[order], label[order]
        raw = block.column("set").combine_chunks() if block.num_rows else []
        sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in order]
        n = np.array([len(s) for s in sets], np.int64)
        signs = np.array([signature(s) for s in sets]).astype(np.uint8)
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        parent = first[place].tolist()  # members of a label start out tied to its first

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        apart = own[0] == -2
        last = int(np.searchsorted(own, -2, side="right")) if apart else len(sets)
        for a in range(last):
            rest = np.arange(last if apart else a + 1, len(sets))
            # sizes alone, then signatures, then the full sets of those not yet tied together
            rest = rest[100 * np.minimum(n[rest], n[a]) >= percent * np.maximum(n[rest], n[a])]
            if len(rest):
                rest = rest[(signs[rest] == signs[a]).sum(1) >= (percent / 100 - _SLACK) * signs.shape[1]]
            for b in rest.tolist():
                x, y = root(a), root(b)
                if x != y:
                    shared = sorted_overlap(sets[a], sets[b])
                    if 100 * shared >= percent * (n[a] + n[b] - shared):
                        parent[max(x, y)] = min(x, y)
                        found.append((int(ids[a]), int(ids[b])))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _confirmed(texts: DataFrame, family: DataFrame, told: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """``(u, v)``: a forest that spans the links of all families, confirmed on full sets."""
    sizes = family.join(told.groupBy("id").agg(F.max("n").alias("n")), "id").groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("hashes") / HASHES)).cast("long")  # by members, and by the size of their sets where these are large
    sizes = scratch.save(sizes.select("family", blocks.alias("blocks")))
    placed = scratch.save(family.join(sizes, "family").select("id", "family", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("i")))
    spread = sizes.where("blocks > 1")
    zero = F.lit(0).cast("long")
    place = lambda i, other, own: F.struct(i.alias("i"), other.alias("other"), F.lit(own).cast("long").alias("own"))
    hubs = _first_of(placed.where("blocks > 1").select("family", "id"), "family", "id").select("id", F.lit(True).alias("hub"))
    own = placed.join(hubs, "id", "left")
    # a hub goes to every block, where it is compared first
    everywhere = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: place(k, zero, -1))
    places = F.when(F.col("hub"), everywhere).otherwise(F.array(place(F.col("i"), zero, 0)))
    kind = "id long, family long, i long, other long, own long, label long, set binary"
    # texts meet their places by a shuffle of both at every size: what is placed grows with the texts
    rows = texts.join(scratch.save(own.select("id", "family", F.col("id").alias("label"), places.alias("places"))).hint("merge"), "id").select("id", "text", "family", "label", "places")
    links = rows.mapInArrow(lean(_full_sets(shingle)), kind).groupBy("family", "i", "other").applyInArrow(_confirm(percent), "u long, v long")
    if spread.isEmpty():
        return links
    links = scratch.save(links)
    labelled = _labelled(placed.join(spread.select("family"), "family", "left_semi").select("family", "i", "id"), links, hubs.select("id"))
    rest, every = _leftovers(scratch.save(labelled), "family", BLOCK, scratch)
    if rest is None:
        return links
    sides = rest.select("family", "id", "label", place(F.col("i"), F.col("other"), -2).alias("p")).union(every.select("family", "id", "label", place(F.col("i"), F.col("other"), 0).alias("p")))
    again = scratch.save(sides.groupBy("id", "family", "label").agg(F.collect_list("p").alias("places")))
    rows = texts.join(again, "id").select("id", "text", "family", "label", "places")
    more = rows.mapInArrow(lean(_full_sets(shingle)), kind).groupBy("family", "i", "other").applyInArrow(_confirm(percent), "u long, v long")
    return links.union(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, name: str = "near") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``percent``: link two documents when ``100 * |A and B| >= percent * |A or B|`` on their sets of
    ``shingle``-word shingles.  Null or wordless texts have an empty set and are linked with nothing;
    shorter texts than a shingle count as one.  Rows that repeat an id are one document with several
    texts: each row is returned, and a link of any of them is a link of the document.  Rows without an
    id are linked with nothing and kept: they get a row with a null ``component_id``.  Texts of any length
    are compared whole, each in the memory of one task.  An empty table gives an empty one.  Other columns are ignored, whatever their names.  A pair at the threshold is missed by all bands with a
    probability under one in two million at 0.85 (under one in ten thousand at 0.8).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = scratch.save(texts.mapInArrow(lean(_describe(shingle)), "id long, n long, fp1 long, fp2 long, bands array<long>, signs binary"))

    every, told = told, told.where("id is not null")
    copies = told.where("fp1 is not null").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("fp1", "fp2", "rep")
    copies = scratch.save(copies)
    member = told.join(copies, ["fp1", "fp2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    others = scratch.save(member.where("id <> rep").select("id", "rep"))

    family = _families(member.where("id = rep and n > 0"), percent, scratch)
    links = _confirmed(texts.where("id is not null"), family, told, shingle, percent, scratch)
    # an id with several texts ties what these are copies of
    again = told.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    links = links.union(others.join(again, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    tied = scratch.save(components(links, scratch))
    others = others.groupBy("id").agg(F.min("rep").alias("rep"))
    out = every.select("id", "n").join(others, "id", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = out.join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    group = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))
