"""Queries that run a stream over the shared tables to its end, and series with arrays of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import waveforms
from strandline.plans.registry import query
from strandline.plans.resolution import _SPANS
from strandline.sources.scratch import Scratch
from strandline.sources.tables import measurements, table
from strandline.streaming import ingest, sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("sr9_stream_sessions", _SPANS + " SELECT owner, source, lo, hi, pieces FROM f")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap sessions of every owner's sources from a stream whose files come in no order of time."""
    root = Scratch(spark, "sessions").root
    m = measurements(spark, sf_dir).select("owner", "source", F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"))
    m.repartition(3, F.xxhash64("lo")).write.parquet(f"{root}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/{n}")
        q = sessions.sessions(stream, 3_600_000_000).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sessions.current(spark.read.schema(sessions.OUT).parquet(f"{root}/out/*"))


@query("sc16_ig5_stream_outcomes", """WITH r AS (SELECT p_partkey AS k, p_partkey // 3 AS key, p_partkey % 3 AS n, p_size % 4 = 0 AS wrong, CASE WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN 'same' ELSE p_name END AS item FROM part),
f AS (SELECT key, min(n) AS n, min_by(item, n) AS item FROM r WHERE NOT wrong GROUP BY key)
SELECT k, CASE WHEN wrong THEN 'rejected' WHEN r.n = f.n THEN 'stored' WHEN r.item = f.item THEN 'replay' ELSE 'conflict' END AS outcome, CASE WHEN wrong THEN '/client/kind' ELSE '' END AS pointers FROM r LEFT JOIN f USING (key)""", events=False)
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of parts, three to a key, checked and kept by a stream: stored, replayed, in conflict or rejected with the place."""
    root = Scratch(spark, "inbox").root
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when((k % 3 == 1) & (F.col("p_size") % 2 == 0), "same").otherwise(F.col("p_name"))
    item = F.struct(F.lit("i").alias("key"), F.lit("2024-01-01T00:00:00Z").alias("sent_at"), F.sha2(name, 256).alias("sha256"), name.alias("body"))
    client = F.struct(F.when(F.col("p_size") % 4 == 0, "robot").otherwise("device").alias("kind"), F.lit("app").alias("name"), F.lit("1").alias("version"))
    body = F.to_json(F.struct(F.lit("ingest.v1").alias("schema"), client.alias("client"), F.lit("scale.measures").alias("stream"), F.array(item).alias("items")))
    p.select(F.expr("p_partkey div 3").cast("string").alias("key"), body.alias("body"), k.cast("long").alias("sent")).repartition(2, "key").write.json(f"{root}/in")
    inbox = ingest.Inbox(spark, f"{root}/store")
    ingest.run_inbox(inbox, f"{root}/in", f"{root}/checkpoint").awaitTermination()
    # the part that a request was made of is the time that it was sent
    held = spark.read.schema(ingest.REQUEST).json(f"{root}/in").withColumn("file", F.col("_metadata.file_name")).select(F.sha2(F.concat_ws("|", "file", "key", "sent", F.sha2("body", 256)), 256).alias("request"), F.col("sent").alias("k"))
    return inbox.table("outcomes").join(held, "request").select("k", "outcome", F.array_join(F.transform("errors", lambda e: e["pointer"]), ",").alias("pointers"))


@query("sc21_nz11_waveforms", """WITH w AS (SELECT vec_id AS id, embedding AS x, len(embedding) AS n, vec_id * 1000000 AS start, 4 + vec_id % 3 AS rate FROM embeddings),
e AS (SELECT *, start + CAST(ceil(n * (1000000.0::DOUBLE / rate)) AS BIGINT) AS fin FROM w), p AS (SELECT *, unnest(range(8)) AS k FROM e),
t AS (SELECT id, k, list_slice(x, k * n // 8 + 1, (k + 1) * n // 8) AS part FROM p), g AS (SELECT id, list(CAST(round(list_min(part)::DOUBLE * 100000) AS BIGINT) ORDER BY k) AS low, list(CAST(round(list_max(part)::DOUBLE * 100000) AS BIGINT) ORDER BY k) AS high FROM t GROUP BY id),
q AS (SELECT *, greatest(0, CAST(ceil(1500000 / (1000000.0::DOUBLE / rate)) AS BIGINT)) AS a, least(n, CAST(ceil(3200000 / (1000000.0::DOUBLE / rate)) AS BIGINT)) AS b FROM e)
SELECT q.id, fin AS "end", array_to_string(low, ',') AS low, array_to_string(high, ',') AS high, start + CAST(floor(a * (1000000.0::DOUBLE / rate)) AS BIGINT) AS part_start, CAST(b - a AS INTEGER) AS part_size, round(list_sum(list_slice(x, a + 1, b))::DOUBLE, 4) AS part_sum FROM q JOIN g USING (id)""", events=False)
def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as series of samples: thinned to eight parts, and cut by a span that starts a second and a half into each."""
    w = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 1_000_000).alias("start"), (F.lit(4) + F.col("vec_id") % 3).alias("rate"), F.col("embedding").alias("samples"))
    spans = w.select("id", (F.col("start") + 1_500_000).alias("lo"), (F.col("start") + 3_200_000).alias("hi"))
    cut = waveforms.within(w, spans, ["id"]).select("id", "part_start", F.size("part").alias("part_size"), F.round(F.aggregate("part", F.lit(0.0), lambda a, x: a + x), 4).alias("part_sum"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 100_000).cast("long").cast("string")), ",").alias(c)
    return waveforms.thinned(w, 8).select("id", "end", text("low"), text("high")).join(cut, "id")
