"""Keys of one part share what is read from and written to the state."""

import json
import random

import pandas as pd

from strandline.streaming import sessions


class Held(dict):
    """A map in place of the state's, with its calls counted."""

    calls = 0

    def getValue(self, key):  # noqa: ANN001, ANN201, N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value) -> None:  # noqa: ANN001, N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key) -> None:  # noqa: ANN001, N802
        self.calls += 1
        self.pop(key, None)


class Version:
    at = None

    def exists(self) -> bool:
        return self.at is not None

    def get(self):  # noqa: ANN201
        return self.at

    def update(self, at) -> None:  # noqa: ANN001
        self.at = at


def test_calls_grow_with_the_buckets_not_with_the_keys():
    rnd, day = random.Random(3), 86_400_000_000
    rows = [(json.dumps([k]), lo := rnd.randrange(20 * day), lo + rnd.randrange(day // 24)) for k in range(200) for _ in range(12)]
    rnd.shuffle(rows)
    s = sessions.Sessions(day // 24)
    s.near, s.version = Held(), Version()
    last = {}
    for batch in (rows[:1500], rows[1500:]):
        for out in s.handleInputRows((0,), iter([pd.DataFrame(batch, columns=["k", "lo", "hi"])]), None):
            for r in out.itertuples(index=False):
                last[r.k, r.lo] = (r.hi, r.pieces, r.live)
    want = {}
    for k in {r[0] for r in rows}:
        run = None
        for _, lo, hi in sorted(r for r in rows if r[0] == k):
            if run and lo - run[1] <= day // 24:
                run[1:] = [max(run[1], hi), run[2] + 1]
            else:
                run = [lo, hi, 1]
            want[k, run[0]] = tuple(run[1:])
    assert {at: r[:2] for at, r in last.items() if r[2]} == want
    assert s.near.calls <= 2 * 2 * 5  # two batches, read and written, over the weeks; before: as often for each of 200 keys
