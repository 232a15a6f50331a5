"""SentencePiece encoding and decoding by the best path through the lattice of pieces.

The pieces of a published vocabulary get integer scores that fall with the logarithm of their rank,
and a text is cut into the pieces whose scores sum to the most: a product of max-plus matrices, one
factor for each character.  A giant text is split into chunks.  Every chunk yields the transfer matrix
between the states of its two ends, the state being how far a piece reaches over a chunk's end; the
matrices are combined associatively, blocks of chunks at a time in as many tasks as there are blocks,
up to the whole text and down again, into the best score of every state at every cut; then each chunk
finds its own pieces from those scores, and knows for every state at its end the state at its start.
These maps from state to state are combined in the same way, from the end of the text, and pick one
answer for each chunk.  Scores are integers, so that sums are exact and the answer doesn't depend on
where a text was cut.

No piece reaches over the start of a run of blanks or over an unknown character, so that between those
places a text falls into segments with a single state, and a cut is put at such a place if one is near.
The distinct segments that a task meets for the first time are cut together: a walk down the trie of
pieces from every character of all of them at once, then one step for each position in all of them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textkit import beside, groups, lean, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in a chunk of a giant text, and how far past that a cut may look for a segment's start.
CHUNK, SEEK = 1 << 16, 1 << 10
#: Segments whose pieces a task remembers, characters in one that is, characters of segments cut together.
MEMORY, SHORT, LOT = 120_000, 64, 1 << 15
#: Bytes of text whose segments are looked up together.
GROUP = 1 << 18
#: Chunks, or blocks of them, that one task combines.
FAN = 64
NONE = -(1 << 60)

_SEGMENT = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces with ids and integer scores; blanks stand for the mark of a word's start."""

    def __init__(self, pieces: list[tuple[int, str]], bytes_: list[int], size: int) -> None:
        self.ids = {p: i for i, p in pieces}
        self.scores = {p: -round(1e6 * log(rank + 2)) for rank, (_, p) in enumerate(pieces)}
        #: Score of every piece, and 1 for every start of a piece that is none itself.
        self.table = {p[:n]: 1 for p in self.ids for n in range(1, len(p))} | self.scores
        self.longest = max(map(len, self.ids), default=1)
        self.byte_score = min(self.scores.values(), default=0) - 10_000_000
        self.byte_ids = bytes_
        self.strings = [b""] * size
        for i, p in pieces:
            self.strings[i] = p.encode()
        for b, i in enumerate(bytes_):
            self.strings[i] = bytes([b])
        #: Ids of segments seen lately, and of those seen before them: what is used again moves to the first.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.trie: Trie | None = None

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a SentencePiece model; control and unknown pieces never stand for text."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        bytes_ = sorted((int(m.id_to_piece(i)[1:-1], 16), i) for i in range(n) if m.is_byte(i))
        if len(bytes_) != 256:
            raise ValueError("the vocabulary has no pieces for single bytes")
        plain = [(i, m.id_to_piece(i).replace("▁", " ")) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        whole = [(i, p) for i, p in plain if " " not in p.lstrip(" ") and "\n" not in p]
        return cls(whole, [i for _, i in bytes_], n)

    def __reduce__(self):
        pieces = sorted(((i, p) for p, i in self.ids.items()))
        return Vocabulary, (pieces, self.byte_ids, len(self.strings))

    def steps(self, s: str, i: int) -> Iterator[tuple[int, int]]:
        """(length, score) of every piece at ``i``; a character that is no piece goes by its bytes."""
        single = False
        for n in range(1, min(self.longest, len(s) - i) + 1):
            score = self.table.get(s[i : i + n])
            if score is None:
                break
            if score <= 0:
                single |= n == 1
                yield n, score
        if not single:
            yield 1, self.byte_score * len(s[i].encode())

    def best(self, s: str, start: list[int] | None = None, stop: int | None = None) -> tuple[list[int], list[int]]:
        """Best score of every position and the start of its last piece; of equal scores the longest piece.

        ``start``: scores of the first positions (0 at the first alone by default).  ``stop``: no piece
        starts from there on.
        """
        score, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        score[: len(start or [0])] = start or [0]
        table, longest, size = self.table, self.longest, len(s)
        for i in range(size if stop is None else stop):  # the loop of ``steps`` written out: every new segment goes through it
            here = score[i]
            if here <= NONE // 2:
                continue
            single = False
            for j in range(i + 1, min(i + longest, size) + 1):
                add = table.get(s[i:j])
                if add is None:
                    break
                if add <= 0:
                    single = single or j == i + 1
                    if here + add > score[j]:
                        score[j], back[j] = here + add, i
            if not single:
                add = self.byte_score * len(s[i].encode())
                if here + add > score[i + 1]:
                    score[i + 1], back[i + 1] = here + add, i
        return score, back

    def cut(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids on the best path to ``end`` and where it starts."""
        spans = []
        while back[end] >= 0:
            spans.append((back[end], end))
            end = back[end]
        out: list[int] = []
        for a, b in reversed(spans):
            i = self.ids.get(s[a:b])
            out += [i] if i is not None else [self.byte_ids[x] for x in s[a:b].encode()]
        return out, end

    def segments(self, new: list[str]) -> None:
        """Put the ids of segments into the memory."""
        if self.trie is None:
            self.trie = Trie(self)
        short = [s for s in new if len(s) <= SHORT]
        for lo, hi in _lots([len(s) for s in short]):
            self.memo.update(zip(short[lo:hi], self.trie.cut(short[lo:hi]), strict=True))
        for s in new:
            if len(s) > SHORT:
                _, back = self.best(s)
                self.memo[s] = array("i", self.cut(s, back, len(s))[0]).tobytes()

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids, as bytes of 32-bit integers, of texts that start and end at segments' ends."""
        parts = [_SEGMENT.findall(t) for t in texts]
        new, older = [], self.older
        for s in sorted(set(chain.from_iterable(parts)).difference(self.memo), key=len):
            if s in older:
                self.memo[s] = older[s]
            else:
                new.append(s)
        self.segments(new)
        memo = self.memo
        out = [b"".join([memo[s] for s in p]) for p in parts]
        for s in reversed(new):  # long ones are not worth their place
            if len(s) <= SHORT:
                break
            del memo[s]
        if len(memo) >= MEMORY // 2:
            self.older, self.memo = memo, {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join([self.strings[i] for i in ids.tolist()]).decode("utf-8", errors="replace")
        return out[1:] if out[:1] == " " else out


def _lots(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of segments, in order of length, that fill ``LOT`` characters when all are as long as the last one."""
    lo = 0
    for hi, n in enumerate(lengths):
        if (hi + 1 - lo) * n > LOT and hi > lo:
            yield lo, hi
            lo = hi
    if lo < len(lengths):
        yield lo, len(lengths)


class Trie:
    """Starts of pieces as numbered nodes, and best paths through many segments at once."""

    def __init__(self, vocab: Vocabulary) -> None:
        starts = sorted(vocab.table, key=len)
        node = {p: i + 1 for i, p in enumerate(starts)}
        node[""] = 0
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in starts], np.int64)
        self.width = 4 * (1 << max(4, len(keys).bit_length()))
        #: Open addressing: (parent node, character) to child node, keys kept whole so that a hit is exact.
        self.keys, self.nodes = np.full(self.width, -1, np.int64), np.zeros(self.width, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            take = left[free[first]]
            self.keys[slot[take]], self.nodes[slot[take]] = keys[take], take + 1
            left = np.setdiff1d(left, take, assume_unique=True)
            slot[left] = (slot[left] + 1) % self.width
        self.score = np.array([NONE] + [vocab.scores.get(p, NONE) for p in starts], np.int64)
        self.ids = np.array([-1] + [vocab.ids.get(p, -1) for p in starts], np.int64)
        self.longest, self.byte_score, self.byte_ids = vocab.longest, vocab.byte_score, np.array(vocab.byte_ids, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.width

    def children(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Node below each of ``node`` by a character, 0 if there is none."""
        keys = node.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.nodes[slot], 0)
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) % self.width
            held = self.keys[slot[more]]
            hit = held == keys[more]
            out[more[hit]] = self.nodes[slot[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out

    def cut(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, which come by length; of equal scores the longest last piece."""
        segments = segments[::-1]  # longest first, so that those still going on are always the first ones
        size = np.array([len(s) for s in segments])
        n, longest = len(segments), int(size[0])
        chars = np.zeros((n, longest), np.int64)
        inside = np.arange(longest)[None, :] < size[:, None]
        chars[inside] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat, row, col = chars.ravel(), *np.nonzero(inside)
        left = size[row] - col
        # nodes[k]: where pieces of k + 1 characters start, and the node of each
        steps, at, node = [], np.arange(len(row)), np.zeros(len(row), np.int32)
        for k in range(self.longest):
            node = self.children(node, flat[row[at] * longest + col[at] + k])
            on = node > 0
            at, node = at[on], node[on]
            steps.append((at, node))
            on = left[at] > k + 1
            at, node = at[on], node[on]
            if not len(at):
                break
        wide = len(steps)
        # add[end, segment, wide - k]: score of the piece of k characters that ends there
        add = np.full((longest + 1, n, wide), NONE, np.int64)
        piece = np.full((longest + 1, n, wide), -1, np.int32)
        for k, (at, node) in enumerate(steps, 1):
            score = self.score[node]
            on = score > NONE
            at, node = at[on], node[on]
            add[col[at] + k, row[at], wide - k] = score[on]
            piece[col[at] + k, row[at], wide - k] = self.ids[node]
        alone = np.ones(len(row), bool)
        if steps:
            at, node = steps[0]
            alone[at[self.score[node] > NONE]] = False
        alone = np.flatnonzero(alone)
        bytes_of = lambda c: 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        add[col[alone] + 1, row[alone], wide - 1] = self.byte_score * bytes_of(chars[row[alone], col[alone]])
        best = np.full((n, wide + longest + 1), NONE, np.int64)
        best[:, wide] = 0
        back = np.zeros((longest + 1, n), np.int32)
        active = np.searchsorted(-size, -np.arange(longest + 1), side="right")
        for j in range(1, longest + 1):
            m = active[j]
            total = best[:m, j : j + wide] + add[j, :m]
            pick = total.argmax(1)  # the first of equals starts first
            back[j, :m] = wide - pick
            best[:m, wide + j] = total[np.arange(m), pick]
        # back along all paths at once
        rows, ends, order = [], [], []
        live, end, step = np.arange(n), size.copy(), 0
        while len(live):
            rows.append(live)
            ends.append(end)
            order.append(np.full(len(live), step))
            end = end - back[end, live]
            live, end, step = live[end > 0], end[end > 0], step + 1
        rows, ends, order = np.concatenate(rows), np.concatenate(ends), np.concatenate(order)
        sort = np.lexsort((-order, rows))
        rows, ends = rows[sort], ends[sort]
        length = back[ends, rows]
        ids = piece[ends, rows, wide - length]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that go by their bytes
            count = np.ones(len(ids), np.int64)
            count[odd] = bytes_of(chars[rows[odd], ends[odd] - 1])
            first = np.cumsum(count) - count
            out = np.repeat(ids, count)
            raw = "".join(map(chr, chars[rows[odd], ends[odd] - 1].tolist())).encode("utf-8", "surrogatepass")
            out[np.repeat(first[odd], count[odd]) + np.arange(len(raw)) - np.repeat(np.cumsum(count[odd]) - count[odd], count[odd])] = self.byte_ids[np.frombuffer(raw, np.uint8)]
            rows, ids = np.repeat(rows, count), out
        cuts_ = (4 * np.searchsorted(rows, np.arange(n + 1))).tolist()
        raw = ids.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip(cuts_[:-1], cuts_[1:], strict=True)][::-1]


def cuts(s: str, chunk: int, seek: int, longest: int) -> list[int]:
    """Where to cut a text: at the first start of a segment past each full chunk, or right there if none is near."""
    out = [0]
    while len(s) - out[-1] > chunk + seek + 2 * longest:
        at = out[-1] + chunk
        for i in range(at, at + seek):
            if (s[i] == " " and s[i - 1] != " ") or s[i] == "\n" or s[i - 1] == "\n":
                at = i
                break
        out.append(at)
    return [*out, len(s)]


def _at_segment(s: str, i: int) -> bool:
    return i in (0, len(s)) or (s[i] == " " and s[i - 1] != " ") or s[i] == "\n" or s[i - 1] == "\n"


def transfer(vocab: Vocabulary, s: str, size: int, whole: bool) -> np.ndarray:
    """Max-plus matrix of a chunk: best score from a piece reaching ``i`` into it to one reaching ``j`` past its ``size`` characters.

    ``s`` goes on past the chunk by the longest piece.  ``whole``: the chunk starts and ends at segments.
    """
    k = vocab.longest
    out = np.full((k, k), NONE, np.int64)
    if whole:
        out[0, 0] = vocab_scores(vocab)[np.frombuffer(vocab.plain([s[:size]])[0], np.int32)].sum()
        return out
    row = np.full((len(s) + k + 1, k), NONE, np.int64)
    for i in range(min(k, size)):
        row[i, i] = 0
    for i in range(size):
        here = row[i]
        for n, add in vocab.steps(s, i):
            np.maximum(row[i + n], here + add, out=row[i + n])
    out[:] = row[size : size + k].T
    return np.maximum(out, NONE)


def vocab_scores(vocab: Vocabulary) -> np.ndarray:
    """Score of each id."""
    if not hasattr(vocab, "by_id"):
        vocab.by_id = np.zeros(len(vocab.strings), np.int64)
        for p, i in vocab.ids.items():
            vocab.by_id[i] = vocab.scores[p]
        vocab.by_id[vocab.byte_ids] = vocab.byte_score
    return vocab.by_id


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


def _chunks(vocab: Broadcast, chunk: int, seek: int):
    """Task function: (key, text) to (key, chunk, size, whole, text with what follows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = vocab.value.longest
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                s = " " + text.as_py()
                at = cuts(s, chunk, seek, k)
                for lo in range(0, len(at) - 1, 64):
                    spans = list(zip(at[lo : lo + 64], at[lo + 1 : lo + 65], strict=False))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(spans), pa.int64()), pa.array(range(lo, lo + len(spans)), pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([_at_segment(s, a) and _at_segment(s, b) for a, b in spans]), pa.array([s[a : b + k] for a, b in spans])],
                        names=["key", "chunk", "size", "whole", "text"],
                    )

    return run


def _matrices(vocab: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [transfer(vocab.value, s, size, whole).tobytes() for size, whole, s in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "chunk", "matrix"])

    return run


@dataclass
class Fold:
    """An associative operation on items stored as bytes, and how a state goes through an item."""

    join: Callable[[bytes, bytes], bytes]
    go: Callable[[bytes, bytes], bytes]
    start: bytes


def best_paths(longest: int) -> Fold:
    """Max-plus products of matrices; a state is the best score of each way into a chunk."""
    square = lambda m: np.frombuffer(m, np.int64).reshape(-1, longest)
    start = np.full((1, longest), NONE, np.int64)
    start[0, 0] = 0
    join = lambda a, b: combine(square(a), square(b)).tobytes()
    return Fold(join, join, start.tobytes())


def entries() -> Fold:
    """Compositions of maps from the state at a chunk's end to that at its start, last chunk first; a state is one number."""
    row = lambda m: np.frombuffer(m, ">i4")
    join = lambda a, b: np.where(row(a) < 0, -1, row(b)[np.maximum(row(a), 0)]).astype(">i4").tobytes()
    return Fold(join, join, np.zeros(1, ">i4").tobytes())


def scan(items: DataFrame, fold: Fold, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """``(key, chunk, state)``: the state before each of ``items(key, chunk, item)``, whose chunks count from 0 in every key.

    ``fan`` items after each other are joined into one of the next level, until one is left of each key;
    then the states go down through the same levels.  No task holds more than ``fan`` items of a key.
    """

    def up(block: pa.Table) -> pa.Table:
        out = None
        for i in np.argsort(np.asarray(block.column("chunk"))).tolist():
            m = block.column("item")[i].as_py()
            out = m if out is None else fold.join(out, m)
        return pa.table({"key": pa.array([block.column("key")[0].as_py()], pa.int64()), "chunk": pa.array([block.column("block")[0].as_py()], pa.int64()), "item": pa.array([out], pa.binary())})

    def down(block: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(block.column("chunk"))).tolist()
        state, out = block.column("state")[0].as_py(), []
        for i in order:
            out.append(state)
            state = fold.go(state, block.column("item")[i].as_py())
        at = pa.array(order)
        return pa.table({"key": block.column("key").take(at), "chunk": block.column("chunk").take(at), "state": pa.array(out, pa.binary())})

    levels = [items.withColumn("block", F.expr(f"chunk div {fan}"))]
    most = items.agg(F.max("chunk")).first()[0] or 0
    while most >= fan:
        most //= fan
        above = scratch.save(levels[-1].groupBy("key", "block").applyInArrow(up, "key long, chunk long, item binary"))
        levels.append(above.withColumn("block", F.expr(f"chunk div {fan}")))
    states = levels[-1].select("key", "block").distinct().withColumn("state", F.lit(fold.start))
    while levels:
        level = levels.pop().join(states, ["key", "block"])
        states = scratch.save(level.groupBy("key", "block").applyInArrow(down, "key long, chunk long, state binary"))
        if levels:
            states = states.withColumnRenamed("chunk", "block")
    return states


def _answers(vocab: Broadcast):
    """Task function: (key, chunk, size, whole, text, state) to (key, chunk, exit, map, ids), one row for each state that the chunk can end in.

    ``map``, in the first row of a chunk, holds the state at the chunk's start for every state at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            rows = []
            for key, chunk, size, whole, s, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, found = np.full(v.longest, -1, ">i4"), []
                if whole:
                    starts[0] = 0
                    found.append((0, np.frombuffer(v.plain([s[:size]])[0], np.int32)))
                else:
                    alpha = np.frombuffer(state, np.int64).tolist()
                    score, back = v.best(s, [a if a > NONE // 2 else NONE for a in alpha[: size + 1]], size)
                    for e in range(min(v.longest, len(s) - size + 1)):
                        if score[size + e] > NONE // 2:
                            ids, starts[e] = v.cut(s, back, size + e)
                            found.append((e, np.array(ids, np.int32)))
                rows += [(key, chunk, e, None if i else starts.tobytes(), ids) for i, (e, ids) in enumerate(found)]
            if rows:
                key, chunk, exit_, map_, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, chunk, exit_)), pa.array(map_, pa.binary()), pa.array(ids, pa.list_(pa.int32()))], names=["key", "chunk", "exit", "map", "ids"])

    return run


def _encode_small(vocab: Broadcast, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            for lo, hi in groups(text_bytes(batch.column(0))[1], GROUP):
                some = batch.slice(lo, hi - lo)
                texts = some.column(0).to_pylist()
                parts = v.plain([" " + t if t else "" for t in texts])
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                mask = some.column(0).is_null()
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)), mask=mask)
                same = [pa.array([t is None or v.decode(np.frombuffer(p, np.int32)) == t for t, p in zip(texts, parts, strict=True)])] if verify else []
                yield pa.RecordBatch.from_arrays([*some.columns[1:], ids, *same], names=[*batch.schema.names[1:], "_ids", *["_same"][: len(same)]])

    return run


def _verify(vocab: Broadcast):
    """Task function: (text, ids, other columns) to (other columns, ids, whether they decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            same = [v.decode(np.asarray(i.values)) == t.as_py() for t, i in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), pa.array(same)], names=[*batch.schema.names[2:], "_ids", "_same"])

    return run


def encode(docs: DataFrame, text_col: str = "text", out: str = "tokens", model: str = MODEL, chunk: int = CHUNK, seek: int = SEEK, fan: int = FAN, name: str = "pieces", verify: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text added as ``out array<int>``, and under ``verify`` whether they decode to exactly the text.

    A null text has null ids and an empty one none.  Texts are encoded whole.  Texts within a chunk
    need no shuffle; chunks of longer ones are spread over tasks of their own.  Repeated rows get the
    same ids; of paths with equal scores the one with the longest last piece counts, whatever the cuts.
    An empty table gives an empty one.  Other columns, whatever their names, stay, but for one named as
    a new column, which takes its place.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(Vocabulary.load(model))
    scratch = Scratch(spark, name)
    flat, fields, names = beside(docs, text_col, "string", (out, verify))
    schema = T.StructType([*fields, T.StructField("_ids", T.ArrayType(T.IntegerType())), *[T.StructField("_same", T.BooleanType())][: verify is not None]])
    long = F.length("_in") > chunk
    small = flat.where(F.col("_in").isNull() | ~long).mapInArrow(lean(_encode_small(vocab, verify is not None)), schema)

    giant = scratch.save(flat.where(long).withColumn("_key", F.monotonically_increasing_id()))
    pieces = giant.select("_key", "_in").mapInArrow(lean(_chunks(vocab, chunk, seek)), "key long, chunk long, size long, whole boolean, text string")
    pieces = scratch.save(pieces.repartition("key", "chunk"))
    matrices = scratch.save(pieces.mapInArrow(lean(_matrices(vocab)), "key long, chunk long, item binary"))
    states = scan(matrices, best_paths(vocab.value.longest), scratch, fan)
    answers = scratch.save(pieces.join(states, ["key", "chunk"]).select("key", "chunk", "size", "whole", "text", "state").mapInArrow(lean(_answers(vocab)), "key long, chunk long, exit long, map binary, ids array<int>"))
    last = answers.groupBy("key").agg(F.max("chunk").alias("last"))
    turned = answers.where("map is not null").join(last, "key").select("key", (F.col("last") - F.col("chunk")).alias("chunk"), F.col("map").alias("item"))
    taken = scan(scratch.save(turned), entries(), scratch, fan).join(last, "key")
    taken = taken.select("key", (F.col("last") - F.col("chunk")).alias("chunk"), F.conv(F.hex("state"), 16, 10).cast("long").alias("exit"))
    ids = answers.join(taken, ["key", "chunk", "exit"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    ids = ids.select("key", F.flatten("parts.ids").alias("_ids"))
    whole = giant.join(ids, F.col("_key") == F.col("key"))
    if verify is not None:
        whole = whole.select("_in", "_ids", *[f.name for f in fields]).mapInArrow(lean(_verify(vocab)), schema)
    return small.union(whole.select(*schema.names)).toDF(*names, out, *[verify][: verify is not None])


def decode(tokens: DataFrame, ids_col: str = "tokens", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text of the ids added under ``out``: null for null ids, and exactly the encoded text otherwise."""
    vocab = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    flat, fields, names = beside(tokens, ids_col, "array<int>", (out,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = vocab.value
        for batch in batches:
            ids = batch.column(0)
            flat_ids, ends = np.asarray(ids.values), np.asarray(ids.offsets)
            texts = [None if not ok else decoder.decode(flat_ids[a:b]) for ok, a, b in zip(np.asarray(ids.is_valid()), ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "_out"])

    return flat.mapInArrow(lean(run), T.StructType([*fields, T.StructField("_out", T.StringType())])).toDF(*names, out)
