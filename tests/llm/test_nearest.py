import numpy as np
from strandline.llm import nearest as module
from strandline.llm.nearest import Hasher, hadamard, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(vecs, k):
    good = {i: np.array(v, np.float64) for i, v in vecs.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            other = sorted(((-float((v * x).sum()), i) for i, x in good.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in other]
    return out


def run(spark, vecs, k=20, **more):
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, "x") for i, v in vecs.items()], SCHEMA)
    got: dict = {}
    for r in sorted(nearest(df, df.where("vec_id % 20 = 0"), k, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_transform_keeps_lengths_and_is_orthogonal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    c = Hasher(12, 2.0, 2, 3)
    x = np.random.default_rng(0).normal(size=(50, 12))
    assert c.padded == 16 and (c.probes(x, 5)[:, :, 0] >= 0).all() and c.cells(x).shape == (3, 50)


def test_recall_on_random_and_grouped_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 24)).astype(np.float32)
    base[700:1200] = base[7] + 0.05 * rng.normal(size=(500, 24))
    base[1200:1230] = base[40]
    base[100] *= 3
    vecs = dict(enumerate(base.tolist()))
    got, want = run(spark, vecs), brute(vecs, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9
    for q, w in got.items():
        for i, s in w:
            assert abs(s - float((np.float64(base[q]) * np.float64(base[i])).sum())) < 1e-12
    assert [i for i, _ in got[40]][:20] == [i for i, _ in want[40]][:20]


def test_few_and_odd_rows(spark):
    odd = {0: [1, 0], 1: [0.5, 0.5], 2: None, 3: [0, 0], 4: [float("nan"), 1], 5: [1, None], 20: [-1, 0], 7: [1, 2, 3], 40: [float("inf"), 0]}
    got = run(spark, odd)
    assert got == {0: [(1, 0.5), (20, -1.0)], 20: [(1, -0.5), (0, -1.0)]}
    three = run(spark, odd | {60: [1, 0, 0], 8: [2, 1, 0], 9: [2, 1, 0]})  # a length that is as common as the other, and ties
    assert three[60] == [(8, 2.0), (9, 2.0), (7, 1.0)] and three[0] == got[0]
    assert run(spark, {0: [1, 0], 20: [1, 2, 3]}) == {}
    assert run(spark, {}) == {} and run(spark, {20: [1, 2]}) == {}


def test_repeated_ids_and_what_was_measured(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(900, 16)).astype(np.float32).tolist()
    rows = [(i, v, 1, "x") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows + rows[:50] + [(7, [9.0] * 16, 1, "x")], SCHEMA)
    report: dict = {}
    got = nearest(df, df.where("vec_id % 20 = 0"), report=report).collect()
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) == 45 * 20
    want = dict(enumerate(vecs)) | {7: min(vecs[7], [9.0] * 16)}
    mine: dict = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(mine, brute(want, 20)) >= 0.9 and min(report["recall"]) >= 0.9


def test_recall_with_two_hashes(spark, monkeypatch):
    """Cells of 8 rows force a second hash; neighbours of random vectors are in no cell near by, whatever the tables."""
    monkeypatch.setattr(module, "ASKS", 8)
    rng = np.random.default_rng(6)
    vecs = dict(enumerate(rng.normal(size=(1200, 24)).astype(np.float32).tolist()))
    want = brute(vecs, 20)
    assert recall(run(spark, vecs, cell=8), want) >= 0.96
    monkeypatch.setattr(module, "TABLES_MOST", 1)
    assert recall(run(spark, vecs, cell=8, tables=1), want) == 1
