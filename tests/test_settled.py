"""Sums that don't depend on the order in which their parts were added."""

import itertools
import math
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from strandline.functions.scalars import settled
from strandline.operators import compiler


def test_sums_are_equal_in_every_order(spark):
    parts = [0.1, 0.2, 0.3, 0.7, 1.7]
    sums = {reduce(add, p) for p in itertools.permutations(parts)} | {3.0}
    assert len(sums) > 1 and {r.s for r in spark.createDataFrame([(x,) for x in sums], "x double").select(settled(F.col("x")).alias("s")).collect()} == {3.0}
    odd = [0.0, -13.68125, 1e-12, 1e300, 1e-300, float("inf"), None, 19.84, -2.9999999999999996]
    got = [r.s for r in spark.createDataFrame([(x,) for x in odd], "x double").coalesce(1).select(settled(F.col("x")).alias("s")).collect()]
    assert got == [0.0, -13.68125, 1e-12, 1e300, 1e-300, float("inf"), None, 19.84, -3.0]
    assert math.isnan(spark.range(1).select(settled(F.lit(float("nan"))).alias("s")).first().s)


def test_an_interval_cut_into_buckets_adds_up_to_its_value(spark):
    size = compiler.BASE
    rows = [(f"r{n}-{v}", "1", n * 7 * 1_000_003, n * 7 * 1_000_003 + n * 60_000_000, v) for n in range(1, 100) for v in (3.0, 13.68, 0.1)]
    df = spark.createDataFrame(rows, "rule string, window_key string, lo long, hi long, value double")
    texts, none = {"owner": "1", "metric": "m", "window": "local_day", "agg": "additive", "intra": "max", "statistic": None, "source_id": "s", "group": "g", "kind": "interval"}, F.lit(None)
    df = df.select("*", *[F.lit(v).cast("string").alias(k) for k, v in texts.items()], none.cast("int").alias("span"), F.lit(False).alias("reported"), F.lit(3.0).alias("low"), F.lit(150.0).alias("high"), none.cast("double").alias("min_coverage"), none.cast("long").alias("staleness"), F.lit(0).cast("long").alias("start"), F.lit(size * 288).alias("end"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(0).alias("pos"), F.expr("hash(rule)").cast("long").alias("id"), none.cast("string").alias("gone"))
    got = {r.rule: r.value for r in compiler.group_values(df, df.select("rule", *compiler._RULE)).collect()}
    assert got == {r[0]: r[4] for r in rows}
