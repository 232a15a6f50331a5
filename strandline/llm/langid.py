"""Language identification by the nearest of several clustered centroids per language.

A text becomes a vector of hashed 2- and 3-grams of its lower-cased UTF-8 bytes: logarithmic counts
times inverse document frequency, scaled to length one.  Each language has several centroids from
spherical k-means over a bounded sample of labelled texts; a text gets the language of the centroid
with the largest cosine, and is rejected where even that cosine is too small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import beside, groups, lean, text_bytes

DIM = 4096
#: Labelled texts that the centroids are fitted on, at most, over all languages; centroids per language.
SAMPLE, CENTROIDS = 2048, 4
#: A text is rejected under this share of a low quantile of the cosines that its language has in the sample.
REJECT, LOW = 0.25, 0.02
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with letters lower-cased (A-Z and the upper row of the Latin-1 letters) and other ASCII as blanks."""
    out = _FOLD[data]
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E)]
    out[upper] += 0x20
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of each text, one row of ``DIM`` per text; a text stands between two blanks."""
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    low = _folded(data).astype(np.uint32)
    for i in range(len(offsets) - 1):
        b = np.concatenate([[32], low[offsets[i] : offsets[i + 1]], [32]]).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        h2 = (two[two != 0x2020] * np.uint32(2654435761)) >> np.uint32(20)
        h3 = (three[(three & 0xFFFF) != 0x2020] * np.uint32(2246822519)) >> np.uint32(20)
        out[i] = np.bincount(h2, minlength=DIM) + np.bincount(h3, minlength=DIM)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``idf[DIM]``, ``centroids[k, DIM]`` with the language of each, and the cosine under which each rejects a text."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def in_training(id_col: Column) -> Column:
    """Rows that labels may be learnt from; a row without an id is one of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (feature, n): texts of this task that hold the feature; feature -1 counts the texts."""
    n, texts = np.zeros(DIM, np.int64), 0
    for batch in batches:
        data, off, _ = text_bytes(batch.column(0))
        for lo, hi in groups(off, 1 << 20):
            tf = counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n += np.count_nonzero(tf, axis=0)
            texts += hi - lo
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], texts))], names=["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off, _ = text_bytes(batch.column(2))
        for lo, hi in groups(off, 1 << 20):
            tf = counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([t.tobytes() for t in tf])], names=["k", "lang", "tf"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; the same rows in the same order give the same centroids."""
    mean = x.sum(0)
    start = [int(np.argmax(x @ mean))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    c = x[start]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> Model | None:
    """Centroids from the labelled rows of ``docs``; None if there are none.

    Document frequencies come from all labelled texts.  ``sample`` bounds the texts that come to the
    driver, drawn evenly from each language by a hash of the id; with more languages than that, one text
    of each comes.  Null texts and labels are left out; repeated rows count as often as they come.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    told = {r.feature: r.n for r in rows.select("text").mapInArrow(lean(_frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n = np.array([told.get(i, 0) for i in range(DIM)], np.float64)
    idf = (np.log((1 + told[-1]) / (1 + n)) + 1).astype(np.float32)
    each = max(1, sample // len(sizes))
    size = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(n))])[F.col("lang")]
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), "text"))
    # about twice as many as are taken, so that the ranking below sees no more than that of any language
    drawn = rows.withColumn("k", key).where(F.pmod("k", F.lit(1 << 30)) < (2 * each + 20) / size * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k", F.xxhash64("text")))
    drawn = drawn.select("k", "lang", "text", rank.alias("i")).where(F.col("i") <= each)
    got = sorted(map(tuple, drawn.select("k", "lang", "text").mapInArrow(lean(_sampled), "k long, lang string, tf binary").collect()))
    centroids, langs, least, model = [], [], [], Model(idf, np.zeros((0, DIM)), [], np.zeros(0))
    for lang in sorted(sizes):
        own = [np.frombuffer(t, np.float32) for _, x, t in got if x == lang][:each]
        if own:
            x = model.vectors(np.array(own))
            c = _kmeans(x, k)
            centroids.append(c)
            langs += [lang] * len(c)
            least += [REJECT * float(np.quantile((x @ c.T).max(1), LOW))] * len(c)
    if not langs:
        return None
    return Model(idf, np.concatenate(centroids).astype(np.float32), langs, np.array(least))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, far = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            letters = np.array([has_letter(t.as_py()) for t in batch.column(0)], bool)
            data, off, _ = text_bytes(batch.column(0))
            if model is not None:
                for lo, hi in groups(off, 1 << 20):
                    cos = model.vectors(counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) @ model.centroids.T
                    best = cos.argmax(1)
                    for i in np.flatnonzero(letters[lo:hi]):
                        lang[lo + i], score[lo + i] = model.langs[best[i]], min(1.0, max(0.0, float(cos[i, best[i]])))
                        far[lo + i] = score[lo + i] < model.least[best[i]]
            rejected = ~letters | far
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[1:], "_lang_pred", "_score", "_rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with predicted language, best cosine and rejection added under ``names``, without a shuffle.

    Texts that are null or hold no letter get ``und``, score 0 and are rejected, as does every text
    when there was nothing to learn from.  Texts are read whole; repeated rows get the same answer; of
    centroids at the same cosine the first language in order counts; an empty table gives an empty one.
    Other columns stay, whatever their names, but for ones named as the new ones, which take their place.
    """
    flat, fields, kept = beside(docs, text_col, "string", names)
    schema = T.StructType(fields).add("_lang_pred", "string").add("_score", "double").add("_rejected", "boolean")
    return flat.mapInArrow(lean(_predict(model)), schema).toDF(*kept, *names)
