import random

import pytest
from brute import near
from strandline.llm import near_dedup
from strandline.llm.components import components
from strandline.llm.near_dedup import near_duplicates
from strandline.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, component_id string, rep int"


def rows_of(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, percent=percent).collect())


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(5000)
    base = [word() for _ in range(200)]
    rows = []
    for i in range(60):  # near copies around one base, at all distances
        t = list(base)
        for _ in range(rnd.randrange(0, 9)):
            t[rnd.randrange(200)] = word()
        rows.append(" ".join(t))
    rows += [" ".join(word() for _ in range(rnd.randrange(1, 80))) for _ in range(40)]
    rows += [rows[3], rows[3].upper(), "\t".join(rows[3].split()), "", None, " \n ", "one two", "One  two", "a b c d e", None]
    rows += [" ".join(base[:k]) for k in range(160, 200, 3)]  # a chain of truncations
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_equals_comparing_all_pairs(spark, seed, percent):
    rows = corpus(seed)
    want = near(rows, percent)
    assert rows_of(spark, rows, percent) == sorted((i, n, c, i == c) for i, (n, c) in want.items())


def test_long_text_empty_table_and_null_id(spark):
    long = " ".join(f"t{i}" for i in range(60000))
    df = spark.createDataFrame([(1, long, "x", 1), (2, long + " tail", "x", 1), (None, long, "x", 1)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(df, percent=85).collect()}
    assert got == {1: (59996, 1, True), 2: (59997, 1, False), None: (59996, None, True)}
    assert rows_of(spark, []) == []


def test_repeated_ids(spark):
    t = " ".join(f"t{i}" for i in range(40))
    u = " ".join(f"u{i}" for i in range(40))
    got = rows_of(spark, [(3, t), (3, t), (5, t), (5, u), (9, u), (7, "alone"), (7, "alone")])
    assert got == [(3, 36, 3, True), (3, 36, 3, True), (5, 36, 3, False), (5, 36, 3, False), (7, 1, 7, True), (7, 1, 7, True), (9, 36, 3, False)]


@pytest.mark.parametrize("bucket,at_once,block,hubs", [(4, 64, 256, 8), (2, 10**6, 5, 1), (6, 100, 9, 2)])
def test_large_buckets_and_families_are_compared_block_by_block(spark, monkeypatch, bucket, at_once, block, hubs):
    for name, value in (("BUCKET", bucket), ("ROWS_AT_ONCE", at_once), ("HASHES", 400), ("BLOCK", block), ("HUBS", hubs)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = corpus(5)
    want = near(rows, 85)
    assert rows_of(spark, rows) == sorted((i, n, c, i == c) for i, (n, c) in want.items())


def test_a_bucket_of_twenty_thousand_different_texts(spark):
    """One family of near copies, none of them equal, with a smaller one and single texts beside it, in time that doesn't grow with the square."""
    rnd = random.Random(3)
    base, other = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = []
    for i in range(20_000):
        t = list(base)
        t[-1 - i % 2] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(30_000 + i, " ".join([*other[:-1], f"y{i}"])) for i in range(50)] + [(40_000 + i, " ".join(f"z{i}_{k}" for k in range(20))) for i in range(50)]
    rnd.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert {tuple(r) for r in got.groupBy("component_id").count().where("count > 1").collect()} == {(0, 20_000), (30_000, 50)}
    assert got.where("kept").count() == 52


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 1), (5, 2), (2, 9), (7, 7), (5, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 5: 1, 9: 1}
