"""Versions of rows: what an incoming batch inserts, leaves, replaces or deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def raw_versions(payloads: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """Payloads that differ from the one before them under the same key, numbered, with the order of what they replace."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = payloads.withColumn("_old", F.lag(digest).over(w)).where(~F.col(digest).eqNullSafe(F.col("_old")) | F.col("_old").isNull()).drop("_old")
    return new.withColumn("version", F.row_number().over(w)).withColumn("supersedes", F.lag(order[-1]).over(w))


def first_of_payload(rows: DataFrame, key: str, order: str, content: list[str]) -> DataFrame:
    """The first row of each key in a payload, with ``conflict`` where a later one differs."""
    w = Window.partitionBy(key)
    same = F.xxhash64(*content)
    marked = rows.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("conflict", F.min(same).over(w) != F.max(same).over(w))
    return marked.where("_n = 1").drop("_n")


def upsert(active: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``(key, action)``: insert, unchanged or supersede for what comes in, keep for what is active alone; nulls equal nulls."""
    a = active.select(key, F.struct(*content).alias("_a"), F.lit(True).alias("_is"))
    b = incoming.select(key, F.struct(*content).alias("_b"), F.lit(True).alias("_new"))
    action = F.when(F.col("_new").isNull(), "keep").when(F.col("_is").isNull(), "insert").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("supersede")
    return a.join(b, key, "full").select(key, action.alias("action"))


def successors(versions: DataFrame, keys: list[str], order: str, id_col: str = "id") -> DataFrame:
    """``versions`` with the id of the version that replaced each, its number, and the number of versions after it."""
    w = Window.partitionBy(*keys).orderBy(order, id_col)
    return versions.withColumn("superseded_by", F.lead(id_col).over(w)).withColumn("version", F.row_number().over(w)).withColumn("depth", F.count("*").over(Window.partitionBy(*keys)) - F.col("version"))


def tombstones(rows: DataFrame, deleted: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``deleted``: named themselves, or as a part (``id#n``) of a series that is named."""
    gone = deleted.select(F.col(id_col).alias("_id")).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, F.split_part(F.col(id_col), F.lit("#"), F.lit(1)) == F.col("_id"), "left").withColumn("deleted", F.col("_gone").isNotNull()).drop("_id", "_gone")


def dirty_dates(before: DataFrame, after: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys (with the local date among them) whose rows differ between two states."""
    a, b = before.select(*keys, *content), after.select(*keys, *content)
    return a.exceptAll(b).union(b.exceptAll(a)).select(*keys).distinct()


def fill(known: DataFrame, seen: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Attributes of devices: what the owner set stays, the latest non-null sighting fills the rest."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = seen.select(key, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns]).distinct().withColumnsRenamed({c: f"_{c}" for c in columns})
    return known.join(last, key, "full").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def prunable(versions: DataFrame, referenced: DataFrame, id_col: str = "id") -> DataFrame:
    """Replaced versions that nothing refers to."""
    return versions.where(F.col("superseded_by").isNotNull()).join(referenced.select(id_col), id_col, "left_anti")
