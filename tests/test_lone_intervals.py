"""Intervals that share no bucket aren't cut into buckets, and a window's groups aren't rows; values and counts are those of the buckets."""

import itertools

from pyspark.sql import functions as F

from strandline.operators import compiler
from strandline.plans import compiled_queries as cq
from strandline.sources import catalogue

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def placed(spark, rows):
    df = spark.createDataFrame(rows, "rule string, window_key string, source_id string, lo long, hi long, value double, gone string")
    texts, none = {"owner": "1", "metric": "m", "window": "hour", "agg": "additive", "intra": "max", "group": "g", "kind": "interval"}, F.lit(None)
    df = df.select("*", *[F.lit(v).alias(k) for k, v in texts.items()], none.cast("string").alias("statistic"), none.cast("int").alias("span"), F.lit(True).alias("reported"), none.cast("double").alias("low"), none.cast("double").alias("high"), none.cast("double").alias("min_coverage"), none.cast("long").alias("staleness"))
    start = F.col("window_key").cast("long") * HOUR
    return df.select("*", start.alias("start"), (start + HOUR).alias("end"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(0).alias("pos"), F.col("lo").alias("id"))


def test_a_lone_interval_counts_as_its_buckets(spark):
    m = 60_000_000
    rows = [
        ("a", "0", "s", 7 * m, 67 * m, 60.0, None),  # alone, clipped at the end of its hour: 53 minutes in 11 buckets
        ("b", "0", "s", 7 * m, 67 * m, 60.0, None), ("b", "0", "t", 20 * m, 30 * m, 30.0, None),  # 13 + 30 + 30 minutes, two buckets shared
        ("c", "0", "s", 7 * m, 67 * m, 60.0, "flagged"), ("d", "1", "s", 61 * m, 61 * m, 5.0, None),
    ]
    df = placed(spark, rows)
    got = {r.rule: (r.value and round(r.value, 9), r.n, r.covered, r.flagged, r.at, r.first) for r in compiler.group_values(df, df.select("rule", *compiler._RULE).distinct()).collect()}
    assert got == {"a": (53.0, 11, 11, 0, 7 * m, 7 * m), "b": (73.0, 13, 11, 0, 20 * m, 7 * m), "c": (None, 0, 0, 11, None, None), "d": (5.0, 1, 1, 0, 61 * m, 61 * m)}


def test_windows_are_resolved_without_sorting_their_buckets(spark):
    rows = [(str(i), "0", "s", 0, HOUR, 1.0, None) for i in range(20)]
    df = placed(spark, rows)
    plan = compiler._aggregated(df, lone=True)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_every_group_of_a_window_is_told(spark):
    docs = cq._documents(spark, SF, "pulse", F.lit('"window":{"kind":"local_day"},"quality":{"plausible_range":[10,60],"exclude_flags":["manual_entry"]},"strategy":{"op":"first_available"}'))
    got = compiler.resolve(docs, catalogue.metrics(spark), cq.rows(spark, SF), cq.sources(spark, SF), cq.NOW, name="all-told")
    groups, results = got.groups.toPandas(), got.results.toPandas()
    assert len(groups) == 3 * len(results) and set(groups["group"]) == {"g0", "g1", "g2"} and (groups["ladder"] == groups["pos"] + 1000).all()
    won = groups[groups["status"] == "selected"]
    assert len(won) == results["value"].notna().sum() and sorted(won["value"]) == sorted(results["value"].dropna())
    assert groups.loc[groups["n"].isna(), "reason"].eq("no_data").all() and groups.loc[groups["n"].isna(), "coverage"].eq(0).all()


def test_a_day_is_the_same_in_every_order_of_its_hours(spark):
    rows = [(str(n), n * 5 + i, x) for n, p in enumerate(itertools.permutations([0.1, 0.2, 0.3, 0.7, 1.7])) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "rule string, start long, value double").coalesce(1)
    group = F.struct(F.col("value").alias("value"), F.lit("g").alias("group"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("first"), F.lit(1000).alias("ladder"))
    texts = {"owner": "1", "metric": "m", "op": "first_available", "least": "1", "use_available": "x", "follow": "", "compose": "first_available", "selected": "g", "status": "direct"}
    df = df.select("*", *[F.lit(v).alias(k) for k, v in texts.items()], F.lit("2024-01-01").cast("date").alias("date"), F.col("start").alias("end"), F.lit(1).alias("valid"), F.array(group).alias("_ok"))
    assert {r.value for r in compiler._composed(df).collect()} == {3.0}
