import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD, fill, walk
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm.mixing import mix, mixed_documents, permute, plan_source, slot_blocks, taken_words, targets

SCHEMA = "doc_id long, text string, source string, size int, s string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=8))
def test_targets_fill_up_to_the_limit(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    t = targets(sizes, w)
    assert all(x <= 2 * n for x, n in zip(t, sizes, strict=True))
    assert sum(t) == pytest.approx(1.5 * sum(sizes))
    below = [(x / v) for x, n, v in zip(t, sizes, w, strict=True) if x < 2 * n - 1e-6]
    assert not below or max(below) == pytest.approx(min(below))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**60))
def test_permutation(n, seed):
    i = np.arange(n)
    assert sorted(to := permute(i, n, np.full(n, seed, np.uint64))) == list(range(n))
    assert (permute(to, n, np.full(n, seed, np.uint64), back=True) == i).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.floats(0, 2), st.integers(0, 2**60))
def test_plan_takes_the_target_exactly(size, factor, seed):
    p = plan_source(size, size * factor, seed, 16)
    if not p.slots:
        assert int(size * factor + 0.5) == 0
        return
    index = slot_blocks(np.arange(p.slots), p.blocks, seed)
    words = np.where(index == p.blocks - 1, p.tail, 16)
    words[-1] = min(words[-1], p.last)
    assert words.sum() == int(size * factor + 0.5)
    assert max(Counter(index.tolist()).values()) <= 2


def test_every_source_meets_its_target(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 7, 90]))), rnd.choice(["a", "a", "a", "é", "Z", None]), 9, "q") for i in range(400)]
    rows += [(400, None, "a", 1, None), (401, "x " * 5000, "big", 1, None), (1007, "same row", "a", 1, "q"), (1007, "same row", "a", 1, "q"), (None, "no id here", "b", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = mix(df, block=32, shard=8)
    got = taken_words(one).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    total = defaultdict(int)
    for _, t, s, *_ in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, fill([total[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = of[r.id]
        taken[s] += r.taken
        assert r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
    assert Counter((r.id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    assert taken == {s: int(want[s] + 0.5) for s in order}
    again = taken_words(mix(df.repartition(7), block=32, shard=8)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # one slot is one block of one source, in a shard of the agreed size
    slots = one.slots.collect()
    assert len({(x.s, x.slot) for x in slots}) == len(slots)
    # what every document gives, word by word
    by_hand = walk([(d.s, d.start, d.size, d.id, d.key) for d in one.documents.collect()], [(x.s, x.block, x.words) for x in slots], 32)
    assert Counter((r.id, r.size, r.taken) for r in got) == Counter((i, n, k) for i, n, k in by_hand)
    # every pass goes through all blocks of a source before the next one begins
    for s in {x.s for x in slots}:
        own = [x.block for x in sorted(slots, key=lambda x: x.slot) if x.s == s]
        n = one.sources.where(f"s = {s}").first().blocks
        for lo in range(0, len(own), n):
            assert len(set(own[lo : lo + n])) == len(own[lo : lo + n])


def test_documents_with_clashing_columns(spark):
    names = ["key", "_row", "_key", "_parts", "s", "start", "row", "size"]
    df = spark.createDataFrame([(i, "a b c " * i, "x", *["keep"] * len(names)) for i in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    got = mixed_documents(df, block=4, shard=2)
    assert got.columns == df.columns
    rows = got.collect()
    assert {tuple(r)[3:] for r in rows} == {("keep",) * len(names)}
    assert sum(len(WORD.findall(r.text)) for r in rows) == int(1.5 * 3 * sum(range(9)) + 0.5)


def test_empty_tables(spark):
    assert taken_words(mix(spark.createDataFrame([], SCHEMA))).collect() == []
    assert [r.taken for r in taken_words(mix(spark.createDataFrame([(1, None, "a", 1, "b"), (2, " ", None, 1, "b")], SCHEMA))).collect()] == [0, 0]
