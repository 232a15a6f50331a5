import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from strandline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term int, n string"


def brute(rows, least=3, ranks=200):
    docs = [((t or ""), l or "", s or "") for t, l, s in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for t, l, s in docs:
        w = TERM.findall(t.translate(LOWER))
        df[l].update(set(w))
        n[l, s].update(w)
        n[l, None].update(w)
    out = []
    for l, s in {(l, s) for _, l, s in docs}:
        kept = [w for w, k in df[l].items() if k >= least]
        def p(s, w):
            total = sum(n[l, s][x] for x in kept)
            return 1 + 1000000000 * (n[l, s][w] + 1) // (total + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = [(sum(f(p(s, w), p(o, w)) for w in kept), o) for l2, o in {(b, c) for _, b, c in docs} if l2 == l and o != s]
        own = [(f(p(s, w), p(None, w)), w) for w in kept if n[l, s][w] and p(s, w) > p(None, w)]
        for part, found in (("pair", pairs), ("term", own)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(l, s, part, w, v, k) for k, (v, w) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def sample(rnd, n):
    words = ["a", "B", "b", "ß", "É", "é", "日本", "x_y", "don't", "zebra", "Zebra"] + [f"w{chr(97 + i)}" for i in range(15)]
    return [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))) if rnd.random() > 0.05 else None, rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None, "S1"])) for _ in range(n)]


def test_equals_counting_by_hand(spark):
    rnd = random.Random(1)
    rows = sample(rnd, 150) + [("only here", "fr", "a"), (None, "it", "a"), ("", "it", "b"), ("word " * 50000 + "b", "en", "s1")]
    rows += rows[:10]  # repeated rows are documents of their own
    df = spark.createDataFrame([(i, *r, 1, "z") for i, r in enumerate(rows)], SCHEMA)
    # a tiny sketch lets rare terms through, and small pieces cut the batches: neither changes the result
    for width, size in ((64, 200), (1 << 16, 1 << 20)):
        got = divergence.audit(df, width=width, size=size)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute(rows)
    assert sorted(map(tuple, divergence.audit(df, ranks=2).collect())) == brute(rows, ranks=2)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_sketch_never_tells_less(spark):
    rnd = random.Random(2)
    rows = [r for r in sample(rnd, 400)]
    df = spark.createDataFrame([(r[0] or "", r[1] or "", r[2] or "") for r in rows], "text string, lang string, source string").repartition(7)
    for width in (16, 1 << 12):
        seen = divergence.sketch(df, 3, width, 500)
        assert seen.max() <= 3
        true = defaultdict(int)
        for t, l, _ in rows:
            for w in set(TERM.findall((t or "").translate(LOWER))):
                true[l or "", w] += 1
        for l in {k[0] for k in true}:
            names = pa.array([w.encode() for x, w in true if x == l], pa.large_binary())
            told = np.min([seen[d, c] for d, c in divergence._cells(pa.array([l]), names, np.arange(len(names)), width)], axis=0)
            assert all(told >= [min(3, true[l, w.as_py().decode()]) for w in names])
    assert len([k for k, n in true.items() if n < 3]) == 0 or (told < 3).any()


def test_counts_beyond_whole_numbers_of_nine_digits(spark):
    df = spark.createDataFrame([(0, 20, 4), (9_000_000_000, 9_500_000_000, 7), (8_999_999_999, 9_500_000_000, 7), (4_000_000_000_000, 5_000_000_000_000, 10)], "n long, total long, v long")
    assert [r.p for r in df.select(divergence._p("n", "total", "v").alias("p")).collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in [(0, 20, 4), (9_000_000_000, 9_500_000_000, 7), (8_999_999_999, 9_500_000_000, 7), (4_000_000_000_000, 5_000_000_000_000, 10)]]
