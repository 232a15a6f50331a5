"""Gap sessions on a stream: spans of a source merged while no more than a gap divides them, in whatever order they arrive.

State holds sessions by buckets of time, each session in every bucket that it reaches, so that a late span meets
the few sessions near it and not the whole history.  Keys are put together in a fixed number of parts: reading or
writing a bucket is a call to the state's server, and one call serves all keys of a part.  A span that bridges two
sessions makes them one; what a batch changes comes out as sessions taken back and sessions put in their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKET = 7 * 86_400_000_000
#: Parts that keys are put together in; state that was kept with another number can't be read on.
PARTS = 4096
_KEY = "owner long, source string"
OUT = "owner long, source string, lo long, hi long, pieces long, live boolean, version long"
Session = tuple[int, int, int]


class _Near:
    """The sessions of the keys of one part that a batch has looked at, bucket by bucket, and which buckets it changed."""

    def __init__(self, state, gap: int) -> None:  # noqa: ANN001
        self.state, self.gap = state, gap
        self.held: dict[int, dict[str, set[Session]]] = {}
        self.changed: set[int] = set()

    def bucket(self, key: str, b: int) -> set[Session]:
        if b not in self.held:
            own = self.held[b] = {}
            found = self.state.getValue((b,))
            if found is not None:
                for k, *s in zip(*found):
                    own.setdefault(k, set()).add(tuple(map(int, s)))
        return self.held[b].setdefault(key, set())

    def _put(self, key: str, s: Session, there: bool) -> None:
        for b in range(s[0] // BUCKET, s[1] // BUCKET + 1):
            (self.bucket(key, b).add if there else self.bucket(key, b).discard)(s)
            self.changed.add(b)

    def add(self, key: str, lo: int, hi: int) -> tuple[list[Session], Session]:
        """The sessions that a span takes in, and the one that they become."""
        near = {s for b in range((lo - self.gap) // BUCKET, (hi + self.gap) // BUCKET + 1) for s in self.bucket(key, b)}
        met = [s for s in near if lo - s[1] <= self.gap and s[0] - hi <= self.gap]
        new = (min([lo, *(s[0] for s in met)]), max([hi, *(s[1] for s in met)]), 1 + sum(s[2] for s in met))
        for s in met:
            self._put(key, s, False)
        self._put(key, new, True)
        return met, new

    def write(self) -> None:
        for b in self.changed:
            kept = sorted((k, *s) for k, own in self.held[b].items() for s in own)
            if kept:
                self.state.updateValue((b,), tuple(map(list, zip(*kept))))
            else:
                self.state.removeKey((b,))


class Sessions(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getMapState("near", "bucket long", "k array<string>, lo array<long>, hi array<long>, n array<long>")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        near = _Near(self.near, self.gap)
        gone: set[tuple[str, Session]] = set()
        fresh: set[tuple[str, Session]] = set()
        for part in rows:
            for k, lo, hi in zip(part["k"].tolist(), part["lo"].tolist(), part["hi"].tolist()):
                met, new = near.add(k, int(lo), max(int(lo), int(hi)))
                taken = {(k, s) for s in met}
                gone |= taken - fresh
                fresh -= taken
                fresh.add((k, new))
        near.write()
        at = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((at,))
        starts = {(k, s[0]) for k, s in fresh}
        out = [(k, *s, False) for k, s in gone if (k, s[0]) not in starts] + [(k, *s, True) for k, s in fresh]
        yield pd.DataFrame({"k": [r[0] for r in out], "lo": [r[1] for r in out], "hi": [r[2] for r in out], "pieces": [r[3] for r in out], "live": [r[4] for r in out], "version": [at] * len(out)})

    def close(self) -> None:
        pass


def sessions(spans: DataFrame, gap: int, parts: int = PARTS) -> DataFrame:
    """Changes of the sessions of a stream of ``spans(owner, source, lo, hi)``: the last version of each (owner, source, lo) is what holds, if it is ``live``.

    Spans of no length or reversed ones are instants at their start.  A repeated span counts as a piece of its own.
    """
    keyed = spans.select(F.pmod(F.xxhash64("owner", "source"), F.lit(parts)).alias("part"), F.to_json(F.struct(F.col("owner").cast("long").alias("owner"), F.col("source").cast("string").alias("source"))).alias("k"), "lo", "hi")
    out = keyed.groupBy("part").transformWithStateInPandas(Sessions(gap), "k string, lo long, hi long, pieces long, live boolean, version long", "Update", "None")
    return out.select(F.from_json("k", _KEY).alias("k"), *out.columns[1:]).select("k.*", *out.columns[1:])


def current(changes: DataFrame) -> DataFrame:
    """``(owner, source, lo, hi, pieces)`` that hold after all ``changes``."""
    last = changes.groupBy("owner", "source", "lo").agg(F.max(F.struct("version", "live", "hi", "pieces")).alias("r"))
    return last.where("r.live").select("owner", "source", "lo", "r.hi", "r.pieces")
