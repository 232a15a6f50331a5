"""Scans of the shared tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time zones that owners live in, by owner modulo three.
ZONES = ("Europe/Berlin", "America/New_York", "Asia/Kolkata")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zone_of(owner) -> F.Column:
    return F.element_at(F.array(*[F.lit(z) for z in ZONES]), (owner % 3 + 1).cast("int"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: the type is the source, the value is the value, and ``k`` in the properties the minutes that an interval lasts.

    Instants are timestamps in UTC; the local date is stored with the row and never derived later.
    """
    e = table(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    zone = zone_of(F.col("user_id"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("source"), start.alias("start_at"),
        F.timestamp_micros(F.unix_micros(start) + k * 60_000_000).alias("end_at"), zone.alias("zone"),
        F.to_date(F.from_utc_timestamp(start, zone)).alias("local_date"), "value", k.alias("k"),
        (F.when(F.col("event_id") % 7 == 0, 1).otherwise(0) + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)).alias("flags"),
    )


# The same rows in DuckDB's SQL, as a list of common table expressions.
SQL = f"""m AS (
  SELECT event_id AS id, user_id AS owner, event_type AS source, epoch_us(ts) AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000 AS e, value,
    ({list(ZONES)!r})[1 + user_id % 3] AS zone, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE (({list(ZONES)!r})[1 + user_id % 3]) AS DATE) AS d,
    CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS flags
  FROM events)"""


def parts_of(df: DataFrame, rows: int = 50_000) -> int:
    """Parts of some ``rows`` each that ``df`` makes, at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = 50_000) -> DataFrame:
    """``df`` in parts of some ``rows``, at least one for each core: a small file of narrow rows is one part or two as it is read, however much is made of each row."""
    return df.repartition(parts_of(df, rows), *keys)
