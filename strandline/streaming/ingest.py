"""Checked ingest as a stream, and raw pages with the cursor that they were read by.

Requests are checked inside each micro-batch: what is wrong goes, with its places, to a second table; what is
right is stored once for each idempotency key, over restarts and other checkpoints, because the keys are a
table of their own.  Pages and the cursor behind them are one step, so that a page is neither lost nor stored twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import normalize
from strandline.sources.scratch import Scratch, released
from strandline.streaming.steps import Steps

REQUEST = "key string, body string, sent long"
PAGE = "stream string, page long, position long, body string"
_KEYS = "key string, digest string"
_ITEMS = "request string, stream string, item string, sent_at string, sha256 string, body string"
_OUT = "request string, key string, outcome string, errors array<struct<pointer:string,detail:string>>"


class Inbox(Steps):
    """``items`` that were taken in, ``outcomes`` of all requests, and ``keys`` with the digest of the body that each first came with, cut by a bucket of keys."""

    BUCKETS = 64

    def table(self, name: str) -> DataFrame:
        schema = {"items": _ITEMS, "outcomes": _OUT}[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*") if self._names(name) else self.spark.createDataFrame([], schema)

    def _known(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.folder}/keys/kb={b}" for b in buckets if self._there(f"keys/kb={b}")]
        return self.spark.read.schema(_KEYS).parquet(*paths) if paths else self.spark.createDataFrame([], _KEYS)

    def apply(self, batch: DataFrame, number: int | None = None) -> None:
        """One batch of ``(key, body, sent, file)``: requests without a key are always stored; the first right body of a key is stored, the same one again a replay, another one a conflict.

        Requests of one batch that share a key go by the time that they were sent, then by their digest.  A request
        that is rejected doesn't claim its key.
        """
        with self._alone(), released():
            self._recover()
            scratch = Scratch(self.spark, "inbox")
            held = scratch.save(batch.select("key", "body", "sent", "file"))
            name = self.name_of("requests", held)
            if not self._there(f"done/{name}"):
                self._plan(held, name, scratch)
                self._finish(name)

    def _plan(self, batch: DataFrame, name: str, scratch: Scratch) -> None:
        digest = F.sha2(F.coalesce("body", F.lit("")), 256)
        kb = F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int").alias("kb")
        told = normalize.checked_batches(batch.withColumn("request", F.sha2(F.concat_ws("|", "file", "key", "sent", digest), 256)))
        told = scratch.save(told.withColumn("digest", digest).withColumn("right", F.size("errors") == 0))
        claims = told.where("right and key is not null").groupBy("key").agg(F.min(F.struct("sent", "digest", "request")).alias("c"))
        claims = scratch.save(claims.select("key", F.col("c.digest").alias("own"), F.col("c.request").alias("first"), kb))
        known = scratch.save(self._known(sorted(r.kb for r in claims.select("kb").distinct().collect())))
        fresh = claims.join(known, "key", "left_anti")
        both = known.select("key", F.col("digest").alias("_d"), F.lit(None).cast("string").alias("_r")).unionByName(fresh.select("key", F.col("own").alias("_d"), F.col("first").alias("_r")))
        out = told.join(both, "key", "left")
        outcome = F.when(~F.col("right"), "rejected").when(F.col("key").isNull() | (F.col("request") == F.col("_r")), "stored").when(F.col("digest") == F.col("_d"), "replay").otherwise("conflict")
        out = scratch.save(out.withColumn("outcome", outcome).select("request", "key", "outcome", "errors", "body"))
        plan = f"{self.folder}/plan/{name}"
        out.select("request", "key", "outcome", "errors").write.parquet(f"{plan}/outcomes")
        item = F.from_json("body", "stream string, items array<struct<key:string,sent_at:string,sha256:string,body:string>>")
        items = out.where("outcome = 'stored'").dropDuplicates(["request"]).select("request", item.alias("b")).select("request", "b.stream", F.explode("b.items").alias("i"))
        items.select("request", "stream", F.col("i.key").alias("item"), "i.sent_at", "i.sha256", "i.body").write.parquet(f"{plan}/items")
        known.unionByName(fresh.select("key", F.col("own").alias("digest"))).select("*", kb).write.parquet(f"{plan}/keys")
        self._touch(f"plan/{name}/ready")

    def _finish(self, name: str) -> None:
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/plan/{name}/{part}")
        read("keys", _KEYS + ", kb int").repartition("kb").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb").parquet(f"{self.folder}/keys")
        read("items", _ITEMS).write.mode("overwrite").parquet(f"{self.folder}/items/{name}")
        read("outcomes", _OUT).write.mode("overwrite").parquet(f"{self.folder}/outcomes/{name}")
        self._touch(f"done/{name}")
        self._delete(f"plan/{name}")


def run_inbox(inbox: Inbox, folder: str, checkpoint: str, per_batch: int = 1) -> StreamingQuery:
    """Requests that arrive as lines of JSON files, each micro-batch checked and stored; ends when there is nothing left."""
    stream = inbox.spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", per_batch).json(folder).withColumn("file", F.col("_metadata.file_name"))
    apply: Callable[[DataFrame, int], None] = inbox.apply
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RawStore(Steps):
    """``raw`` pages and, in the same step, the ``cursors`` behind them: pages before a stream's cursor are there already and are passed over."""

    def raw(self) -> DataFrame:
        return self.spark.read.schema(PAGE).parquet(f"{self.folder}/raw/*") if self._names("raw") else self.spark.createDataFrame([], PAGE)

    def cursors(self) -> DataFrame:
        """``(stream, next)``: the first page of each stream that isn't stored."""
        kind = "stream string, next long"
        found = self.spark.read.schema(kind).parquet(f"{self.folder}/cursors/*") if self._names("cursors") else self.spark.createDataFrame([], kind)
        return found.groupBy("stream").agg(F.max("next").alias("next"))

    def apply(self, batch: DataFrame, number: int | None = None) -> None:
        """One batch of pages, all of a stream's from its cursor on or some that are stored; a page comes whole or not at all."""
        with self._alone(), released():
            self._recover()
            scratch = Scratch(self.spark, "pages")
            new = batch.select("stream", "page", "position", "body").join(self.cursors(), "stream", "left").where("next is null or page >= next").drop("next")
            new = scratch.save(new)
            ends = scratch.save(new.groupBy("stream").agg((F.max("page") + 1).alias("next")))
            if ends.isEmpty():
                return
            name = self.name_of("pages", new)
            new.write.parquet(f"{self.folder}/plan/{name}/raw")
            ends.write.parquet(f"{self.folder}/plan/{name}/cursors")
            self._touch(f"plan/{name}/ready")
            self._finish(name)

    def _finish(self, name: str) -> None:
        for part, schema in (("raw", PAGE), ("cursors", "stream string, next long")):
            self.spark.read.schema(schema).parquet(f"{self.folder}/plan/{name}/{part}").write.mode("overwrite").parquet(f"{self.folder}/{part}/{name}")
        self._delete(f"plan/{name}")


def run_pages(store: RawStore, options: dict[str, str], checkpoint: str) -> StreamingQuery:
    """All pages that a paged source has (see ``strandline.sources.paged``) into the store."""
    from strandline.sources.paged import PagedSource

    store.spark.dataSource.register(PagedSource)
    reader = store.spark.readStream.format(PagedSource.name()).options(**options)
    apply: Callable[[DataFrame, int], None] = store.apply
    return reader.load().writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
