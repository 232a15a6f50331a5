"""Every query outside the llm subpackage against its DuckDB SQL on the smallest tables, and episodes against brute force."""

import datetime
import decimal
import glob
import hashlib
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions.shape import shape
from strandline.operators import episodes, joins, strategy, windows
from strandline.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in got.description], got.fetchall())


def brute_clusters(rows, least):
    """Least id among spans of an owner that overlap enough, by repeated relabelling."""
    label = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for o, a, lo, hi in rows:
            for p, b, l2, h2 in rows:
                shared = min(hi, h2) - max(lo, l2)
                if o == p and shared > 0 and shared >= least * min(hi - lo, h2 - l2) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return label


def test_episodes_against_brute_force(spark):
    rows = [(o, 10 * o + i, lo, lo + n) for o in range(4) for i, (lo, n) in enumerate([(0, 10), (4, 10), (9, 3), (30, 5), (33, 20), (35, 2), (100, 1)])]
    df = spark.createDataFrame(rows, "owner long, id long, lo long, hi long")
    got = {r.id: r.cluster for r in episodes.clusters(df, ["owner"], 0.5).collect()}
    assert got == brute_clusters(rows, 0.5)


def one_by_one(rows, least):
    """Clusters by taking links in order: the best overlap first, of equal ones the pair that starts first; one specific kind in a cluster."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    root, kind = {r[1]: r[1] for r in rows}, {r[1]: r[4] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for n, (o, a, lo, hi, _) in enumerate(rows):
        for p, b, l2, h2, _ in rows[n + 1 :]:
            short = min(hi - lo, h2 - l2)
            if o == p and short > 0 and (min(hi, h2) - max(lo, l2)) / short >= least:
                links.append((-(min(hi, h2) - max(lo, l2)) / short, lo, a, l2, b))
    for _, _, a, _, b in sorted(links):
        x, y = find(a), find(b)
        if x != y and (kind[x] is None or kind[y] is None or kind[x] == kind[y]):
            root[y] = x
            kind[x] = kind[x] or kind[y]
    groups = {}
    for r in rows:
        groups.setdefault(find(r[1]), []).append(r[1])
    return {i: min(g) for g in groups.values() for i in g}


def test_links_count_one_by_one(spark):
    rnd = random.Random(5)
    rows = [(o, 100 * o + i, s := rnd.randrange(0, 60), s + rnd.randrange(1, 30), rnd.choice([None, "run", "walk", "ride"])) for o in range(5) for i in range(18)]
    rows += [(9, 9002, 0, 10, "run"), (9, 9001, 0, 10, "walk"), (9, 9003, 0, 10, None), (9, 9004, 2, 12, None)]  # ties
    df = spark.createDataFrame(rows, "owner long, id long, lo long, hi long, sport string")
    got = {r.id: r.cluster for r in episodes.best_first_clusters(df, ["owner"], 0.5, "sport").collect()}
    assert got == one_by_one(rows, 0.5)
    assert episodes.best_first_clusters(df.limit(0), ["owner"], 0.5, "sport").count() == 0


def test_local_hours_of_half_hour_zones_and_clock_changes(spark):
    at = lambda *t: int(datetime.datetime(*t, tzinfo=datetime.UTC).timestamp() * 1e6)
    rows = [("Asia/Kolkata", at(2024, 1, 9, 18, 30), at(2024, 1, 10, 18, 30)), ("Europe/Berlin", at(2025, 10, 25, 22), at(2025, 10, 26, 23)), ("Europe/Berlin", at(2025, 3, 29, 23), at(2025, 3, 30, 22))]
    parts = windows.local_parts(spark.createDataFrame(rows, "zone string, lo long, hi long"), "lo", "hi").groupBy("zone", "lo", "local_date").count().collect()
    assert sorted((str(r.local_date), r["count"]) for r in parts) == [("2024-01-10", 24), ("2025-03-30", 23), ("2025-10-26", 25)]
    held = windows.local_parts(spark.createDataFrame(rows, "zone string, lo long, hi long"), "lo", "hi")
    assert {r.n for r in held.groupBy("lo").agg(F.sum(F.col("part_hi") - F.col("part_lo")).alias("n")).collect()} == {h - lo for _, lo, h in rows}


def test_a_follower_falls_back_and_pools_list_empty_windows(spark):
    v = spark.createDataFrame([(1, 0, 5.0, None), (1, 1, 6.0, None), (2, 0, 7.0, "stale"), (2, 1, None, "no_data")], "w int, pos int, value double, reason string")
    led = spark.createDataFrame([(1, None), (2, 0)], "w int, selected int")
    got = {r.w: (r.value, r.selected, r.status, r.warning) for r in strategy.follow(v, led, ["w"]).collect()}
    assert got == {1: (5.0, 0, "fallback", "follow_unavailable"), 2: (None, None, "no_data", "follow_unavailable")}
    few = {r.w: (r.value, r.status, r.warning) for r in strategy.pool(v, ["w"], "mean", 3).collect()}
    assert few == {1: (5.5, "calculated", "insufficient_sources"), 2: (None, "no_data", None)}
    gated = strategy.gates(spark.createDataFrame([(None, 2, 0), (None, 0, 1), (None, 0, 0), (3.0, 1, 0)], "value double, implausible int, flagged int"))
    assert [r.reason for r in gated.collect()] == ["implausible", "flagged", "no_data", None]


def test_fuzzy_tolerance_is_the_incoming_values(spark):
    a = spark.createDataFrame([(1, "x", 0, 0, 10000.0), (2, "x", 0, 0, 10001.05), (3, "x", 0, 0, float("nan"))], "id int, k string, s long, e long, value double")
    b = spark.createDataFrame([("x", 0, 0, 10001.0001)], "k string, s long, e long, value double")
    assert sorted(r.id for r in joins.fuzzy(a, b, ["k"]).collect()) == [2, 3]


def test_shapes():
    assert shape('{"a.b":1,"a":{}}') != shape('{"a":{"b":1}}')
    assert shape("true") == "v1:" + hashlib.sha256(b"$:boolean").hexdigest()
    assert shape('{"a":1,"a":"x","<":null}') == "v1:" + hashlib.sha256(b'$."\\u003c":null\n$."a":number\n$."a":string\n$:object').hexdigest()
    assert shape("[" * 258 + "]" * 258) is None and shape("[" * 100000) is None and shape("{") is None and shape(None) is None and shape("NaN") is None
    assert shape("[" * 257 + "]" * 257) is not None


def test_no_spans(spark):
    df = spark.createDataFrame([], "owner long, id long, lo long, hi long")
    assert episodes.clusters(df, ["owner"], 0.5).count() == 0


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, DATA).count() >= 0
