import numpy as np
from brute import components
from strandline.llm import graph_dedup
from strandline.llm.graph_dedup import near_vectors

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


def test_whole_compares_all_whatever_their_number(spark, monkeypatch):
    """The bound on comparing outright doesn't change what the query links."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[299] = x[17] + 0.02 * rng.normal(size=24).astype(np.float32)
    vecs = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in vecs.items()], SCHEMA)
    monkeypatch.setattr(graph_dedup, "_known_links", lambda *a: {})
    monkeypatch.setattr(graph_dedup, "_audit_found", lambda *a: {})
    monkeypatch.setattr(graph_dedup, "OUTRIGHT", 10)
    told: dict = {}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, report=told, whole=True).collect()}
    assert told["exact"] and got == brute(vecs, 0.95)
