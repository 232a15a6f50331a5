"""Days built again meet rows and hours by a shuffle, and hold all that reaches into them."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from strandline.operators import gold
from strandline.sources.scratch import Scratch
from strandline.streaming import marks

LASTS = "source = 'steps'"


def _rows(spark, rows):
    df = spark.createDataFrame([(k, 1, s, "Europe/Berlin", a, b, v, False, 0) for k, s, a, b, v in rows], marks.ROW)
    return df.withColumn("local_date", marks.local_date())


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_interval_of_days_counts_in_a_day_built_again(spark):
    rows = _rows(spark, [("a", "steps", datetime(2024, 1, 1, 8), datetime(2024, 1, 6, 8), 100.0), ("b", "steps", datetime(2024, 1, 5, 9, 2), datetime(2024, 1, 5, 9, 44), 5.0), ("c", "pulse", datetime(2024, 1, 5, 9), datetime(2024, 1, 5, 9), 60.0)])
    want = gold.hourly(rows, ["owner", "source"], F.expr(LASTS))
    marked = spark.createDataFrame([(1, "steps", "2024-01-05")], "owner long, source string, d string").select("owner", "source", F.to_date("d").alias("local_date"))
    got = marks.rebuilt(want, rows, marked, F.expr(LASTS))
    assert want.count() == 121 and sorted(got.collect()) == sorted(want.collect())


def test_marks_are_not_sent_whole_to_every_task(spark):
    scratch = Scratch(spark, "days")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 60_000_000)
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 50).alias("owner"), F.lit("pulse").alias("source"), F.lit("UTC").alias("zone"), at.alias("start_at"), at.alias("end_at"), F.lit(1.0).alias("value"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("seq")).withColumn("local_date", marks.local_date())
    rows = scratch.save(rows)
    hours, marked = scratch.save(gold.hourly(rows, ["owner", "source"], F.expr(LASTS))), scratch.save(rows.where("owner < 5").select(*marks.DAY).distinct())
    got = marks.rebuilt(hours, rows, marked, F.expr(LASTS))
    assert "Broadcast" not in _plan(got) and got.exceptAll(hours).isEmpty() and got.count() == hours.count()


def test_hours_keep_a_row_for_a_part_and_grow_in_tasks(spark):
    rows = spark.range(300_000).select((F.col("id") % 400).alias("owner"), F.lit("steps").alias("source"), F.lit("Asia/Kolkata").alias("zone"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1_000_000).alias("start_at"), F.lit(2.0).alias("value"))
    rows = rows.withColumn("end_at", F.expr("start_at + interval 5 hours"))
    got = gold.hourly(rows.coalesce(1), ["owner", "source"], F.expr(LASTS))
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", _plan(got))]
    assert tasks and set(tasks) == {6}
    assert abs(got.agg(F.sum("interval_sum")).first()[0] - 600_000) < 1e-3 and got.agg(F.max("buckets")).first()[0] == 12
