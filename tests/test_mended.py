"""Plans and results that were wrong once."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import episodes, exchange, gold, joins, sleep
from strandline.sources import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_neither_broadcast_nor_shuffle_the_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_name")
    df = joins.any_like(rows, spark.createDataFrame([("%1",), ("Part#%7%",), (None,)], "pattern string"), "p_name", "pattern")
    assert not any(x in plan_of(df) for x in ("Broadcast", "NestedLoop", "Exchange", "Join"))


def test_like_patterns_mean_what_like_means(spark):
    texts = ["", "a", "ab", "a.b", "axb", "a%b", "a_b", "a\\b", "\\Eq", "x\ny", "A", None, "100%"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in ["", "%", "a", "a_b", "a\\_b", "a\\%b", "a\\\\b", "%b", "\\\\E%", "x%y", "_", "100\\%"]:
        want = {r.t for r in rows.where(F.col("t").like(p)).collect()}
        assert {r.t for r in joins.any_like(rows, spark.createDataFrame([(p,)], "p string"), "t", "p").collect()} == want, p
    assert joins.any_like(rows, spark.createDataFrame([], "p string"), "t", "p").count() == 0


def test_a_list_that_is_too_long_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(joins, "PATTERNS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        joins.any_like(spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([("a",), ("b",), ("c",)], "p string"), "t", "p")


def test_the_digest_sees_equal_lines_and_an_import_refuses_what_was_changed(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(9, "z"), (9, "z"), (2, "y")], "k long, v string")
    assert exchange._digest(a).first() != exchange._digest(b).first() and exchange._digest(a).first() == exchange._digest(a.repartition(3).orderBy("k")).first()
    folder = "file://" + str(tmp_path / "out")
    exchange.export({"t": a, "empty": a.limit(0)}, folder)
    assert exchange.load_intact(spark, folder, "t", "k bigint, v string").count() == 3 and exchange.load_intact(spark, folder, "empty", "k bigint, v string").count() == 0
    b.coalesce(1).write.mode("overwrite").json(folder + "/t")
    with pytest.raises(ValueError, match="manifest"):
        exchange.load_intact(spark, folder, "t", "k bigint, v string")


def test_tables_are_released_by_thread_and_after_errors(spark, tmp_path):
    import threading

    seen = {}

    def other():
        seen["other"] = scratch.Scratch(spark, "other").save(spark.range(3))

    with pytest.raises(RuntimeError), scratch.released():
        mine = scratch.Scratch(spark, "mine").save(spark.range(5))
        t = threading.Thread(target=other)
        t.start()
        t.join()
        raise RuntimeError
    assert seen["other"].count() == 3
    with pytest.raises(Exception):  # noqa: B017
        mine.count()


def test_islands_cut_by_time_equal_those_of_one_window(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.choice([1, None]), lo := rnd.randrange(-500, 2000), lo + rnd.choice([0, 1, 5, 300])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, lo long, hi long")
    for bucket in (7, 50, 10_000):
        got = {tuple(r) for r in episodes.islands(df, ["k"], "lo", "hi", 3, bucket).select("k", "lo", "hi", "island").distinct().collect()}
        assert got == {tuple(r) for r in episodes.islands(df, ["k"], "lo", "hi", 3).select("k", "lo", "hi", "island").distinct().collect()}


def test_the_median_gap_is_the_upper_one_of_two(spark):
    at = [0, 10, 10, 25, 100, 400, 100_000]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(at)] + [(None, 9, 5), (None, 10, 8)], "k int, id int, s long").withColumn("start_at", F.timestamp_micros(F.col("s") * 1_000_000))
    gaps = sorted(b - a for a, b in zip(at, at[1:]))
    got = {r.k: r.spacing for r in gold.spacing(df, ["k"], bucket=60_000_000, cell=20_000_000).collect()}
    assert got == {1: gaps[len(gaps) // 2] * 1_000_000, None: 3_000_000}


def test_every_episode_has_a_result(spark):
    keys = ["owner", "night"]
    spans = spark.createDataFrame([(1, 1, 10, 0, 100, True), (1, 1, 11, 200, 300, False), (1, 2, 12, 0, 50, True)], "owner int, night int, episode int, start long, end long, main boolean")
    codes = ", ".join(f"{c} double" for c in sleep.CODES)
    rows = [(1, 1, 10, 0, "a", 0.2, 0, 20, "partial_episode", *[5.0] * 10), (1, 1, 10, 1, "b", 0.9, 5, 95, None, *[7.0] * 9, None), (1, 2, 12, 0, "a", 1.0, 0, 50, None, *[3.0] * 10), (1, 2, 12, 1, "b", 1.0, 0, 50, None, *[4.0] * 10)]
    valued = spark.createDataFrame(rows, f"owner int, night int, episode int, pos int, source string, coverage double, first long, last long, reason string, {codes}")
    got = {r.episode: (r.selected, r.status, list(r.warnings)) for r in sleep.select(valued, spans, keys).collect()}
    assert got == {10: (1, "fallback", ["preferred_source_unavailable"]), 11: (None, "no_data", []), 12: (0, "direct", [])}
    assert {r.episode: r.selected for r in sleep.select(valued, spans, keys, op="latest").collect()} == {10: 1, 11: None, 12: 0}
    assert {r.episode: r.sleep_total for r in sleep.pooled(valued, spans, keys, "mean").collect()} == {10: 7.0, 11: None, 12: 3.5}


def test_excluded_and_unmatched_workouts_are_never_shown(spark):
    rows = [(1, 0, 100, -1), (2, 0, 90, None), (3, 0, 10, 1), (4, 0, 20, 1)]
    df = spark.createDataFrame([(7, *r) for r in rows] + [(8, 5, 0, 10, -1)], "cluster int, id int, lo long, hi long, place int")
    got = {r.cluster: (r.id, r.alternates) for r in episodes.pick(df, ["cluster"], "place").collect()}
    assert got == {7: (4, 3), 8: (None, 1)}
