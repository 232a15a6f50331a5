"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has a logistic score over its distinct known tokens, 0 if it has none; a document is toxic if any sentence is, so
its score is the noisy-or of its sentences' scores, and the weights are fitted through that noisy-or
on document labels alone.  The fitted sentence scores then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import MARKS, beside, groups, lean, text_bytes, word_hashes, word_spans

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 5000
#: A token takes part if it is in two documents of the sample at least, and in toxic ones more often than chance by so many
#: standard errors.  Which of these levels serves best, an inner split of the sample tells, whatever its size and label rate.
LEVELS, FOLDS = (6.0, 4.0, 3.0, 2.0), 3
#: Documents and sentences from this score on are called toxic.
THRESHOLD = 0.3
_ROUNDS, _RATE, _RIDGE = 80, 0.25, 0.3

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F, 0x0A, 0x7C]] = True  # ! . ? line end |


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and sentence of each token, first token of each text, and start and end byte of each sentence (sentences without tokens aside)."""
    starts, ends, first = word_spans(data, offsets, MARKS)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first, starts, ends
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])[starts]
    new = np.concatenate([[True], stops[1:] != stops[:-1]])
    heads = first[:-1][first[:-1] < len(starts)]
    new[heads] = True
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(starts)]]) - 1
    return word_hashes(data, starts, ends), np.cumsum(new) - 1, first, starts[at], ends[last]


@dataclass
class Model:
    """Sorted token hashes with a weight each, and the bias of a sentence."""

    tokens: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """One logit per sentence from the distinct known tokens in it."""
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        z = np.full(n, -np.inf)  # a sentence without any known token is no instance: it scores 0, however many there are
        if len(self.tokens) and n:
            at = np.searchsorted(self.tokens, hashes)
            at[at == len(self.tokens)] = 0
            known = np.flatnonzero(self.tokens[at] == hashes)
            pair = np.unique(sentence[known] * len(self.tokens) + at[known])
            held = pair // len(self.tokens)
            z[np.unique(held)] = self.bias
            z += np.bincount(held, self.weights[pair % len(self.tokens)], n)
        return z


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Sample:
    """Labelled documents as pairs: (document, token) and (sentence, token), over the tokens that two documents hold."""

    def __init__(self, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.label = np.array([y for y, _, _ in docs], np.float64)
        own = [np.unique(h) for _, h, _ in docs]
        of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(h) for h in own])
        all_ = np.concatenate([*own, np.zeros(0, np.uint64)])
        del own
        self.tokens, df = np.unique(all_, return_counts=True)
        self.tokens = self.tokens[df >= 2]
        self.doc, self.tok = self._known(all_, of)
        del all_, of, df
        base = np.cumsum([0] + [int(s[-1]) + 1 if len(s) else 0 for _, _, s in docs])
        width, pairs = max(1, len(self.tokens)), [np.zeros(0, np.int64)]
        for lo in range(0, len(docs), 256):  # a few documents at a time, so that nothing of all tokens is held twice
            some = docs[lo : lo + 256]
            row, tok = self._known(np.concatenate([h for _, h, _ in some]), np.concatenate([s + base[lo + i] for i, (_, _, s) in enumerate(some)]))
            pairs.append(np.unique(row * width + tok))
        pair = np.concatenate(pairs)
        del pairs
        self.row, self.row_tok = pair // width, (pair % width).astype(np.int32)
        self.row_doc = (np.searchsorted(base, self.row, side="right") - 1).astype(np.int32)

    def _known(self, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, hashes)
        at[at == len(self.tokens)] = 0
        known = self.tokens[at] == hashes
        return of[known].astype(np.int64), at[known]

    def chosen(self, inside: np.ndarray, level: float) -> np.ndarray:
        """Which tokens are in toxic documents of ``inside`` by ``level`` standard errors more often than chance."""
        use = inside[self.doc]
        df = np.bincount(self.tok[use], minlength=len(self.tokens))
        held = np.bincount(self.tok[use], self.label[self.doc[use]], len(self.tokens))
        rate = self.label[inside].mean()
        with np.errstate(divide="ignore", invalid="ignore"):
            lift = (held - df * rate) / np.sqrt(df * rate * (1 - rate))
        return (df >= 2) & (np.nan_to_num(lift) >= level)

    def sentences(self, inside: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token and sentence of each pair, numbered afresh, and the document of each sentence; sentences without any of the tokens are none."""
        use = inside[self.row_doc] & tokens[self.row_tok]
        place = np.cumsum(tokens) - 1
        rows, at = np.unique(self.row[use], return_inverse=True)
        first = np.searchsorted(self.row[use], rows)
        return place[self.row_tok[use]], at, self.row_doc[use][first]

    def weights(self, inside: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Weight of each token and the bias, by Adam on the noisy-or likelihood."""
        feature, row, doc_of = self.sentences(inside, tokens)
        names = np.flatnonzero(inside)
        doc_of, label, n = np.searchsorted(names, doc_of), self.label[inside], int(tokens.sum())
        theta = np.zeros(n + 1)
        theta[-1] = -2.0
        m, v, share = np.zeros_like(theta), np.zeros_like(theta), 1 / len(label)
        for t in range(1, _ROUNDS + 1 if n else 1):
            z = theta[-1] + np.bincount(row, theta[feature], len(doc_of))
            total = np.bincount(doc_of, _softplus(z), len(label))
            p = 1 / (1 + np.exp(-z))
            pull = np.where(label[doc_of] > 0, -1 / np.expm1(np.clip(total, 1e-9, 500))[doc_of], 1.0) * p
            grad = np.append(np.bincount(feature, pull[row], n), pull.sum()) * share
            grad[:-1] += _RIDGE * theta[:-1] * share
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta -= _RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return theta

    def likelihood(self, inside: np.ndarray, tokens: np.ndarray, theta: np.ndarray) -> float:
        """Log-likelihood of the labels of ``inside``."""
        feature, row, doc_of = self.sentences(inside, tokens)
        z = theta[-1] + np.bincount(row, theta[feature], len(doc_of))
        p = -np.expm1(-np.bincount(doc_of, _softplus(z), len(self.label)))[inside]
        p, y = np.clip(p, 1e-3, 1 - 1e-3), self.label[inside]
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def train(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Weights from (label, token hashes, sentence numbers) of documents; the level of evidence is the one that foretells labels of documents left out best, the strictest of equals."""
    docs = [d for d in docs if len(d[1])]
    held = Sample(docs)
    every = np.ones(len(docs), bool)
    if not len(docs) or held.label.min() == held.label.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    toxic = held.label > 0  # every fold gets its share of either label
    fold, best, level = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) % FOLDS, -np.inf, LEVELS[0]
    for candidate in LEVELS:
        total = 0.0
        for f in range(FOLDS):
            inside = fold != f
            if not inside.any() or inside.all() or held.label[inside].min() == held.label[inside].max():
                continue
            tokens = held.chosen(inside, candidate)
            total += held.likelihood(~inside, tokens, held.weights(inside, tokens))
        if total > best + 1e-9:
            best, level = total, candidate
    tokens = held.chosen(every, level)
    theta = held.weights(every, tokens)
    return Model(held.tokens[tokens], theta[:-1], float(theta[-1]))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, token hashes, sentence numbers)."""
    for batch in batches:
        data, off, _ = text_bytes(batch.column(2))
        h, s = [], []
        for lo, hi in groups(off):
            hashes, sent, first, _, _ = sentences(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                h.append(hashes[a:b].tobytes())
                s.append((sent[a:b] - (sent[a] if b > a else 0)).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h, pa.binary()), pa.array(s, pa.binary())], names=["id", "label", "h", "s"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Weights from the labelled rows of ``docs``.

    ``sample`` bounds the documents that come to the driver: the first ones by a hash of the id, so that the same rows
    give the same model in whatever order they come.  Null labels and texts are left out; a document labelled
    twice is toxic if any label says so; a text that repeats under one id counts once; texts of any length are
    read whole; other columns are ignored.  With nothing to learn from every score is 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(drawn), "id").select("id", "label", "text").mapInArrow(lean(_tokens), "id long, label int, h binary, s binary")
    got = rows.distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id", "h", "s").limit(sample).collect()
    got = sorted((r.id, r.label, r.h, r.s) for r in got)
    return train([(y, np.frombuffer(h, np.uint64), np.frombuffer(s, np.int32)) for _, y, h, s in got])



def _score(model: Model, at: float):
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, found = np.zeros(batch.num_rows), []
            data, off, _ = text_bytes(batch.column(0))
            for lo, hi in groups(off):
                part = data[off[lo] : off[hi]]
                hashes, sent, first, starts, ends = sentences(part, off[lo : hi + 1] - off[lo])
                z = model.logits(hashes, sent)
                ones = np.concatenate([[0], np.cumsum(_softplus(z))])
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    if a == b:
                        found.append([])
                        continue
                    s0, s1 = sent[a], sent[b - 1] + 1
                    score[lo + i] = -np.expm1(-max(0.0, ones[s1] - ones[s0]))
                    p = 1 / (1 + np.exp(-z[s0:s1]))
                    found.append([{"sentence": part[starts[k] : ends[k]].tobytes().decode(), "score": float(p[k - s0])} for k in np.flatnonzero(p >= at) + s0])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array(found, kind)], names=[*batch.schema.names[1:], "_score", "_found"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", at: float = THRESHOLD, names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """``docs`` with the score of each text and its offending sentences added under ``names``, without a shuffle.

    Null and wordless texts score 0 and have no sentences.  Whole texts are read; repeated rows get
    the same answer; sentences come in the order of the text, whatever their scores; an empty table
    gives an empty one.  Other columns stay, whatever their names, but for ones named as the new ones,
    which take their place.
    """
    flat, fields, kept = beside(docs, text_col, "string", names)
    schema = T.StructType([*fields, T.StructField("_score", T.DoubleType())])
    schema = schema.add("_found", T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])))
    return flat.mapInArrow(lean(_score(model, at)), schema).toDF(*kept, *names)
