"""Whole tables out to files and back: exports with a manifest, imports that skip what is there, files of other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(df: DataFrame) -> DataFrame:
    """``(rows, digest)``: number of rows and two sums of their hashes, which don't depend on their order or on how files were cut, but on how often each row is there."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.concat_ws("/", total(F.xxhash64(line)), total(F.xxhash64(F.lit(1), line))).alias("digest"))


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines, and a manifest with rows, digest and schema of each."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}", ignoreNullFields=False)
        one = _digest(df).select(F.lit(name).alias("name"), "rows", "digest", F.lit(df.schema.json()).alias("schema"))
        manifest = one if manifest is None else manifest.union(one)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of JSON lines by an explicit schema; a line that doesn't fit ends the job."""
    return spark.read.schema(schema).json(f"{folder}/{name}", mode="FAILFAST")


def load_intact(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """``load``, refused unless the table is as the manifest of its export says."""
    found = verified(spark, folder, {name: schema}).where(F.col("name") == name).first()
    if found is None or not found.intact:
        raise ValueError(f"{name} is not what its manifest says")
    return load(spark, folder, name, schema)


def verified(spark: SparkSession, folder: str, schemas: dict[str, str]) -> DataFrame:
    """``(name, rows, intact)`` of the tables of an export, held against its manifest."""
    told = spark.read.schema("name string, rows long, digest string").json(f"{folder}/manifest")
    found = None
    for name, schema in schemas.items():
        one = _digest(load(spark, folder, name, schema)).select(F.lit(name).alias("name"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        found = one if found is None else found.union(one)
    same = (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
    return told.where(F.col("name").isin(list(schemas))).join(found, "name", "full").select("name", F.coalesce("_rows", F.lit(0)).alias("rows"), F.coalesce(same, F.lit(False)).alias("intact"))


def import_new(incoming: DataFrame, stored: DataFrame, key: str, refs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of an import that aren't there yet, under ids of this store, and the map ``(old_id, id)`` of all.

    Ids come from the key, so that the same record gets the same id wherever it is imported; ``refs`` are
    columns that hold ids of other rows and are mapped too.
    """
    known = stored.select(key, F.col("id").alias("_have"))
    placed = incoming.join(known, key, "left").withColumn("_new", F.coalesce("_have", F.xxhash64(key)))
    ids = placed.select(F.col("id").alias("old_id"), F.col("_new").alias("id"))
    out = placed.where("_have is null").drop("id", "_have").withColumnRenamed("_new", "id")
    for ref in refs:
        out = out.join(ids.select(F.col("old_id").alias(ref), F.col("id").alias("_to")), ref, "left").withColumn(ref, F.col("_to")).drop("_to")
    return out, ids


def export_csv(df: DataFrame, folder: str) -> None:
    """Active rows as CSV with a header; text with line ends, quotes and formulas stays text."""
    df.write.mode("overwrite").csv(folder, header=True, quoteAll=True, escape='"')


def read_health_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(type, start, end, value, unit, source)`` of the records of a phone's XML export."""
    schema = "_type string, _startDate string, _endDate string, _value string, _unit string, _sourceName string"
    r = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    at = lambda c: F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss Z")
    return r.select(F.col("_type").alias("type"), at(F.col("_startDate")).alias("start"), at(F.col("_endDate")).alias("end"), F.col("_value").alias("value"), F.col("_unit").alias("unit"), F.col("_sourceName").alias("source"))
