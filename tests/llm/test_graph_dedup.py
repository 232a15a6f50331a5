import numpy as np
from brute import components
from strandline.llm import graph_dedup
from strandline.llm.graph_dedup import near_vectors, prune

SCHEMA = "vec_id long, embedding array<float>, n int, id string"


def brute(vecs, t):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in vecs.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = x @ x.T >= t
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(s, 1)), strict=True)]
    comp = components(vecs, links)
    n = dict.fromkeys(vecs, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in vecs}


def run(spark, vecs):
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, "x") for i, v in vecs.items()], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}


def test_prune_keeps_directions_apart():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert prune(x @ x.T, np.array([[1, 2, 3], [-1] * 3, [0, -1, -1], [2, 1, 0]]), degree=3).tolist() == [[1, 3, -1], [-1] * 3, [0, -1, -1], [2, -1, -1]]


def test_a_search_walks_the_graph_from_its_start():
    rng = np.random.default_rng(1)
    angle = np.linspace(0, np.pi, 200)
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    links = np.array([[max(0, i - 1), min(199, i + 1)] for i in range(200)])  # a chain: the only way is along it
    q = x[[150, 20]]
    sim = graph_dedup.range_search(x, links, np.array([[75], [75]]), q, 0.999)
    for row, want in zip(sim, q @ x.T, strict=True):
        assert set(np.flatnonzero(want >= 0.999)) == set(np.flatnonzero(row >= 0.999))
    assert np.isinf(sim[0, 0]) and rng is not None  # what lies the other way is never looked at


def test_groups_among_random_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2600, 32))
    for g in range(60):  # small groups
        base[600 + 10 * g : 610 + 10 * g] = base[g] + 0.1 * rng.normal(size=(10, 32)) * (1 + g % 2)
    base[1300:1900] = base[100] + 0.14 * rng.normal(size=(600, 32))  # a large one with pairs on both sides of the threshold
    base[2000:2060] = base[101]
    base[2060:2090] = 3 * base[101]
    vecs = dict(enumerate(base.tolist())) | {5000: None, 5001: [0.0] * 32, 5002: [float("nan")] * 32, 5003: [None] * 32}
    got, want = run(spark, vecs), brute(vecs, 0.95)
    assert got.keys() == want.keys()
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert 0.995 * there <= found <= there
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(got[i] == want[i] for i in (101, *range(2000, 2090), 5000, 5001, 5002, 5003))


def test_few_rows(spark):
    assert run(spark, {}) == {}
    assert run(spark, {5: None}) == {5: (0, 5, True)}
    assert run(spark, {3: [1, 0], 1: [1, 0.01], 2: [0, 1], 9: [1, 2, 3]}) == {1: (1, 1, True), 3: (1, 1, False), 2: (0, 2, True), 9: (0, 9, True)}


def test_pairs_that_shards_lose_are_found(spark, monkeypatch):
    """A shard a vector and no more: the links of a large group are found, those of pairs on borders are not, till all are compared."""
    monkeypatch.setattr(graph_dedup, "SHARD", 8)
    monkeypatch.setattr(graph_dedup, "OVERLAP", 1)
    monkeypatch.setattr(graph_dedup, "OVERLAP_MOST", 1)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 8))
    base[450:] = base[:450] + 0.12 * rng.normal(size=(450, 8))
    base = np.concatenate([base, base[0] + 0.01 * rng.normal(size=(300, 8))])
    vecs = dict(enumerate(base.tolist()))
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in vecs.items()], SCHEMA)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, report=report).collect()}
    assert got == brute(vecs, 0.95)
    assert report["recall"][0][1]["all"] <= 1 and report["recall"][-1][1]["all"] == 1


def test_links_are_found_across_shards_in_later_rounds(spark, monkeypatch):
    """Small shards and blocks, one shard a vector to be built in but none to be asked for beyond its own: the graph leads on."""
    monkeypatch.setattr(graph_dedup, "MOST", 64)
    monkeypatch.setattr(graph_dedup, "SHARD", 32)
    monkeypatch.setattr(graph_dedup, "LOCAL", 256)
    monkeypatch.setattr(graph_dedup, "ASKS", 32)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 24))
    base[200:900] = base[0] + 0.1 * rng.normal(size=(700, 24))  # one group over many blocks
    for i in range(900, 1100):
        base[i] = base[i + 200] + 0.1 * rng.normal(size=24)
    vecs = dict(enumerate(base.tolist()))
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in vecs.items()], SCHEMA)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, report=report).collect()}
    want = brute(vecs, 0.95)
    there = sum(n for n, _, _ in want.values())
    assert 0.99 * there <= sum(n for n, _, _ in got.values()) <= there
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_everything_is_compared_where_the_search_falls_short(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "RECALL", 1.1)
    monkeypatch.setattr(graph_dedup, "OVERLAP_MOST", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 8))
    base[200:] = base[:200] + 0.12 * rng.normal(size=(200, 8))
    vecs = dict(enumerate(base.tolist())) | {1000: [1.0, 0.0], 1001: [1.0, 0.01], 1002: [0.0, 1.0]}
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in vecs.items()], SCHEMA)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, report=report).collect()}
    small = brute({i: v for i, v in vecs.items() if i >= 1000}, 0.95)
    assert report["exact"] and got == brute({i: v for i, v in vecs.items() if i < 1000}, 0.95) | small


def test_recall_is_averaged_over_vectors_and_sizes():
    known, got = {1: 5000, 2: 1, 3: 1, 4: 2}, {1: 5000, 3: 1, 4: 1}
    assert graph_dedup.recalls(known, got) == {"all": 0.625, "1000-9999": 1.0, "1-9": 0.5}


def test_no_link_is_lost_within_a_shard(spark, monkeypatch):
    """All vectors in one shard, in groups so large that the nearest of each fill any list of neighbours and none leads to another group."""
    monkeypatch.setattr(graph_dedup, "_known_links", lambda *_: {})  # without an audit, so that nothing is made good
    rng = np.random.default_rng(4)
    one = np.concatenate([np.eye(64)[g] + 0.02 * rng.normal(size=(240, 64)) for g in range(4)])
    vecs = dict(enumerate(one.tolist()))
    monkeypatch.setattr(graph_dedup, "SHARD", len(vecs))
    assert run(spark, vecs) == brute(vecs, 0.95)


def test_links_so_rare_that_the_sample_has_none(spark, monkeypatch):
    """The audit says that it measured nothing, and all are compared; beyond the bound it says so and keeps what was found."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[699] = x[17] + 0.02 * rng.normal(size=24).astype(np.float32)
    vecs = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in vecs.items()], SCHEMA)
    monkeypatch.setattr(graph_dedup, "_known_links", lambda *a: {})
    told: dict = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, report=told).collect()}
    assert told["exact"] and told["recall"][0][1] == "unmeasured" and told["audited"] == 0
    assert got == brute(vecs, 0.95)
    monkeypatch.setattr(graph_dedup, "OUTRIGHT", 10)
    near_vectors(df, report=told)
    assert not told["exact"] and told["recall"] == [(graph_dedup.OVERLAP, "unmeasured")]


def test_without_a_link_in_the_sample_found_ones_are_audited(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[300:310] = x[5] + 0.02 * rng.normal(size=(10, 24)).astype(np.float32)
    real, calls = graph_dedup._known_links, []

    def first_none(*a):
        calls.append(len(a[1]))
        return {} if len(calls) == 1 else real(*a)

    monkeypatch.setattr(graph_dedup, "_known_links", first_none)
    told: dict = {}
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)], SCHEMA)
    near_vectors(df, report=told)
    assert told["audited"] == 11 and told["recall"][-1][1]["all"] >= graph_dedup.RECALL
