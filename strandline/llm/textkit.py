"""Vectorised byte-level text helpers shared by the operators of this subpackage.

Everything here works on one Arrow batch inside a Spark task: UTF-8 bytes of whole texts in one
numpy array, with the offsets of each text.  Nothing keeps state between batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task; a longer single text forms a group of its own.
GROUP_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets (one more than rows) and validity of a string column, without copying texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most ``limit`` bytes (or one longer text)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that hands free memory back when its task is over: Python workers wait for the next task with all they hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit integers (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown when a longer group comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INV))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


#: Bytes between the tokens of letters and digits (bytes beyond ASCII count as letters).
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and per text the index of its first word (one more entry than texts)."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    np.logical_not(between[data], out=solid[1:-1].view(bool))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    step = solid[1:] - solid[:-1]
    inner = cut & (solid[1:] == 1) & (solid[:-1] == 1)  # a word of one text touches a word of the next
    starts = np.flatnonzero((step == 1) | inner)
    ends = np.flatnonzero((step == -1) | inner)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z lower-cased when ``lower``)."""
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    b = (_LOWER[data] if lower else data).astype(np.uint64)
    b += np.uint64(1)
    b *= up[:-1]
    np.cumsum(b, out=total[1:])
    h = total[ends] - total[starts]
    h *= down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


_SHINGLE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; all words as one if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, size)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _SHINGLE[i]
    return np.unique(mix64(out + np.uint64(k)))


def sorted_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def beside(df: DataFrame, column: str, kind: str, new: tuple[str | None, ...] = ()) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """``df`` with ``column`` once more in front, as ``_in``, and the others under names that clash with nothing; and the names that they had.

    Columns that are named as one of the ``new`` ones are left out: those take their place.
    """
    names = [c for c in df.columns if c not in new]
    fields = [T.StructField(f"c{i}", df.schema[c].dataType, df.schema[c].nullable) for i, c in enumerate(names)]
    return df.select(df[column].cast(kind), *[df[c] for c in names]).toDF("_in", *[f.name for f in fields]), fields, names
