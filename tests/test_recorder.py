"""The group that recorded a workout leads in its hour, even where its source has no rows of the metric."""

from pyspark.sql import functions as F

from strandline.plans import compiled_queries as cq


def test_a_recorder_needs_no_rows_of_the_metric(spark, tmp_path):
    hour = 1_704_103_200_000_000
    rows = [(3, 5, 1, "view", 40.0, 0), (9, 10, 1, "signup", 50.0, 0), (12, 15, 1, "signup", 60.0, 0), (1, 0, 1, "purchase", 9.0, 60)]  # pulses of g2, g2 and g1, and a workout of purchase:1
    df = spark.createDataFrame(rows, "event_id long, minute long, user_id long, event_type string, value double, k int")
    ts = F.timestamp_micros(F.lit(hour) + F.col("minute") * 60_000_000).cast("timestamp_ntz")
    df.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.format_string('{"k": %d}', "k").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in cq.compiled_contexts(spark, str(tmp_path)).collect()]
    assert got == [(1, "2024-01-01T10:00:00Z", "workout", 60.0, "g1")]
