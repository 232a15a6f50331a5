"""Kept results: hits without a resolution, misses alone, closed windows, waiting marks, overrides and rules as other keys."""

import datetime

from pyspark.sql import functions as F

from strandline.streaming import results
from strandline.streaming.results import ResultCache

KEYS = "owner long, metric string, kind string, local_date date, rule_ref string, fp string"
DAY = datetime.date(2024, 1, 1)


def keys(spark, *rows):
    return spark.createDataFrame([(o, "m", "local_day", DAY + datetime.timedelta(d), ref, fp) for o, d, ref, fp in rows], KEYS)


class Resolver:
    def __init__(self):
        self.asked = []

    def __call__(self, missed):
        self.asked.append(sorted((r.owner, (r.local_date - DAY).days, r.rule_ref, r.fp) for r in missed.collect()))
        got = missed.where("owner <> 3")  # owner 3 has no windows
        return got.select("*", F.col("local_date").cast("string").alias("window_key"), (F.col("owner") * 10 + F.length("fp")).cast("double").alias("value"), (F.datediff("local_date", F.lit(DAY)) + 1).cast("long").alias("window_end"))


def test_a_second_read_resolves_nothing(spark, tmp_path):
    cache, r = ResultCache(spark, "file://" + str(tmp_path / "c"), "window_key string, value double, window_end long", owners=2), Resolver()
    want = keys(spark, (1, 0, "a", ""), (1, 1, "a", ""), (2, 0, "a", ""), (3, 0, "a", ""))
    show = lambda df: sorted(map(str, df.select("owner", "local_date", "value").collect()))
    first = show(cache.read(want, r, now=9))
    assert len(first) == 3 and len(r.asked) == 1

    def never(missed):
        raise AssertionError("resolved")

    again = cache.read(want, never, now=9)
    assert show(again) == first
    assert all("results" not in p or "c/" in p for p in again.inputFiles())
    # one key more: it alone is resolved, and the others of its part stay
    cache.read(want.union(keys(spark, (4, 0, "a", ""))), r, now=9)
    assert r.asked[1] == [(4, 0, "a", "")]
    cache.read(want.union(keys(spark, (4, 0, "a", ""))), never, now=9)
    # another rule, another override
    cache.read(keys(spark, (1, 0, "b", ""), (1, 0, "a", "1/x")), r, now=9)
    assert r.asked[2] == [(1, 0, "a", "1/x"), (1, 0, "b", "")]
    cache.read(want, never, now=9)


def test_open_windows_and_waiting_marks_are_not_kept(spark, tmp_path):
    cache, r = ResultCache(spark, "file://" + str(tmp_path / "c"), "window_key string, value double, window_end long", owners=2), Resolver()
    want = keys(spark, (1, 0, "a", ""), (1, 5, "a", ""), (2, 0, "a", ""))
    marks = spark.createDataFrame([(2, DAY)], "owner long, local_date date")
    cache.read(want, r, now=3, marks=marks)
    cache.read(want, r, now=9, marks=None)
    assert r.asked[1] == [(1, 5, "a", ""), (2, 0, "a", "")]
    cache.read(want, lambda m: 1 / 0, now=9)
    ranges = spark.createDataFrame([(1, "m", DAY - datetime.timedelta(3), DAY), (7, "m", DAY, DAY)], "owner long, metric string, lo date, hi date")
    cache.invalidate(ranges)
    cache.read(want, r, now=9)
    assert r.asked[2] == [(1, 0, "a", "")]


def test_fingerprints_mind_no_order_but_every_override(spark):
    rows = [(1, "m", DAY, "set", 4.0), (1, "m", DAY, "force", None), (1, "m", DAY, "set", 4.0)]
    schema = "owner long, metric string, local_date date, kind string, value double"
    fp = lambda rs: results.fingerprints(spark.createDataFrame(rs, schema), ["kind", "value"]).first().fp
    assert fp(rows) == fp(rows[::-1]) and len({fp(rows), fp(rows[:2]), fp(rows[:1]), fp(rows[1:2])}) == 4


def test_ranges_that_touch_become_one(spark):
    d = lambda n: DAY + datetime.timedelta(n)
    rows = [(1, "m", d(0), d(2)), (1, "m", d(3), d(3)), (1, "m", d(5), d(9)), (1, "m", d(6), d(7)), (1, "n", d(0), datetime.date(9999, 12, 31)), (1, "n", d(50), d(60)), (1, "m", d(0), d(2))]
    got = results.merged_ranges(spark.createDataFrame(rows, "owner int, metric string, lo date, hi date")).collect()
    assert sorted((r.metric, r.lo, r.hi) for r in got) == [("m", d(0), d(3)), ("m", d(5), d(9)), ("n", d(0), datetime.date(9999, 12, 31))]
