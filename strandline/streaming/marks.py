"""Incremental work without watermarks: late, corrected and deleted rows mark the days that they touch, and marked days are built again.

A batch of rows goes through the same steps whether it is the first of its day or comes a year late:
versions are decided by key, the local dates before and after are marked, and the hours of the marked
days and their neighbours are replaced.  A batch that is given twice changes nothing the second time.
Marks wait in a queue until they have settled; they are taken in runs of days and go together with the
hours that were built from them, while marks that come in between stay.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import gold
from strandline.sources.scratch import Scratch, released
from strandline.sources.tables import parts_of
from strandline.streaming.steps import Steps

ROW = "key string, owner long, source string, zone string, start_at timestamp, end_at timestamp, value double, deleted boolean, seq long"
DAY = ["owner", "source", "local_date"]
# How many days before and after a date its results read, and how far back the widest of them do.
BEFORE, AFTER, WEAR, LATEST = 3, 2, 30, 366


def local_date(at: str = "start_at", zone: str = "zone") -> Column:
    return F.to_date(F.from_utc_timestamp(at, F.col(zone)))


def last_of_batch(batch: DataFrame) -> DataFrame:
    """One row of each key of a batch, the last by ``seq``, with the local date that is stored with it."""
    rest = [c for c in batch.columns if c != "key"]
    one = batch.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("key", "r.*")
    return one.withColumn("local_date", local_date())


def merged(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stored`` rows after a batch, and the ``(owner, source, local_date)`` marks of what changed, old dates and new ones.

    A row older (by ``seq``) than the stored one, or equal to it, changes nothing; a deleted one stays as a
    deleted row, so that an older version that comes later doesn't bring it back.
    """
    new = last_of_batch(batch)
    content = [c for c in new.columns if c not in ("key", "seq")]
    old = stored.select("key", F.struct(*content).alias("_old"), F.col("seq").alias("_s"))
    both = new.join(old, "key", "left").where("_s is null or (seq > _s and not (struct(" + ", ".join(content) + ") <=> _old))")
    seen = both.where("not deleted or not _old.deleted")
    marks = seen.select(*DAY).union(seen.where("_old is not null").select("_old.owner", "_old.source", "_old.local_date")).distinct()
    after = stored.join(both.select("key"), "key", "left_anti").unionByName(both.select(stored.columns))
    return after, marks


def widened(marks: DataFrame, days: int = 1) -> DataFrame:
    """Marks with their neighbouring days: a row's own date can fall beside that of the owner's timeline."""
    return marks.select("owner", "source", F.explode(F.sequence(F.date_sub("local_date", days), F.date_add("local_date", days))).alias("local_date")).distinct()


def rebuilt(hours: DataFrame, rows: DataFrame, marks: DataFrame, interval: Column) -> DataFrame:
    """``hours`` with those of marked days and their neighbours built again from ``rows``; the others stay as they are.

    Marked days grow with the batch and aren't sent whole to every task: rows and hours meet them by a shuffle.
    """
    days, n = widened(marks), parts_of(hours)
    fresh = gold.hourly(rows.where("not deleted"), ["owner", "source"], interval, days=days)
    kept = hours.repartition(n, *DAY).join(days.repartition(n, *DAY).hint("shuffle_hash"), DAY, "left_anti")
    return kept.unionByName(fresh.select(hours.columns))


def reach(rules: DataFrame) -> DataFrame:
    """``(metric, dep, before, after)``: what results of a metric read, and how many days around a date: its own codes, its leaders', wear and sleep.

    ``rules(metric, codes, leader_codes, wear, kind)``; results of the latest kind read a year back, wear a month.
    """
    back = F.when(F.col("kind") == "latest", LATEST).otherwise(F.when(F.col("wear").isNotNull(), WEAR).otherwise(BEFORE))
    night = F.col("kind").isin("local_night", "sleep_episode")
    deps = F.array_distinct(F.array_compact(F.concat(F.array("metric"), F.col("codes"), F.coalesce("leader_codes", F.array().cast("array<string>")), F.array("wear", F.when(night, F.lit("sleep"))))))
    return rules.select("metric", F.explode(deps).alias("dep"), back.alias("before"), F.lit(AFTER).alias("after"))


def invalidated(cache: DataFrame, marks: DataFrame, reaches: DataFrame, activated: DataFrame) -> DataFrame:
    """``cache(metric, kind, owner, local_date, rule_ref)`` less what a mark reaches, or whose rule isn't the active one any more.

    ``marks(owner, dep, local_date)``; ``activated(metric, rule_ref)``.
    """
    days = marks.join(reaches, "dep").select("owner", "metric", F.explode(F.sequence(F.date_sub("local_date", F.col("after")), F.date_add("local_date", F.col("before")))).alias("local_date")).distinct()
    kept = cache.join(days, ["owner", "metric", "local_date"], "left_anti")
    return kept.join(activated.select("metric", F.col("rule_ref").alias("_ref")), "metric", "left").where("_ref is null or _ref = rule_ref").drop("_ref")


def cacheable(results: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """Results that may be kept: of windows that have closed, on days without a mark that waits."""
    return results.where(F.col("window_end") <= now).join(marks.select("owner", "local_date").distinct(), ["owner", "local_date"], "left_anti")


def due_units(cursors: DataFrame, now: Column, lookback: int, unit: int) -> DataFrame:
    """``(stream, lo, hi)``: spans of ``unit`` to fetch for each ``cursors(stream, high)``, from ``lookback`` before the high mark, for corrections, up to now."""
    lo = F.expr(f"(high - {lookback}) div {unit}")
    return cursors.select("stream", F.explode(F.sequence(lo, F.floor((now - 1) / F.lit(unit)))).alias("_u")).select("stream", (F.col("_u") * unit).alias("lo"), F.least((F.col("_u") + 1) * unit, now).alias("hi"))


class Store(Steps):
    """Rows, hours and marks in folders that are replaced in parts.

    - ``rows`` and ``hours`` are cut by a bucket of owners and the local date, so that one late row rewrites
      neither the date of other owners nor other dates;
    - ``index`` tells the part that a key's row is in, cut by a bucket of keys: a batch meets the buckets of
      its own keys, and then the parts that these are in, and reads nothing else;
    - ``marks`` is the queue of marked days with the instant at which each arrived, ``consumed`` what was taken.

    A step first writes all that it will change to ``plan/<name>``.  From then on it can be done again as
    often as need be: whatever was cut short is finished before anything else is done.  Batches go by a
    digest of their rows, not by a number, so that streams with other checkpoints, or several of them,
    can feed one store; a lock file keeps their steps apart.
    """

    OWNERS, KEYS = 16, 256
    #: Days that one rebuild takes from the queue.
    RUN = 31

    def __init__(self, spark: SparkSession, folder: str, interval: Column, settle: float = 0.0, clock: Callable[[], float] = time.time) -> None:
        """``settle``: seconds that a mark waits; with 0 every batch rebuilds what it has marked at once."""
        super().__init__(spark, folder)
        self.interval, self.settle, self.clock = interval, settle, clock
        self.rows_schema = spark.createDataFrame([], ROW + ", local_date date").schema
        self.hours_schema = gold.hourly(spark.createDataFrame([], self.rows_schema), ["owner", "source"], interval).schema

    # tables

    def _schema(self, name: str):  # noqa: ANN202
        return self.hours_schema if name == "hours" else self.rows_schema

    def _bucket(self, owner: str = "owner") -> Column:
        return F.pmod(F.xxhash64(owner), F.lit(self.OWNERS)).cast("int").alias("ob")

    def _read(self, name: str, parts: list[tuple[int, str]] | None = None) -> DataFrame:
        """A table, or the given parts of it; a part that lost all its rows is kept by a row of nulls."""
        schema = self._schema(name)
        paths = [f"{self.folder}/{name}"] if parts is None else [f"{self.folder}/{name}/ob={b}/local_date={d}" for b, d in parts]
        paths = [p for p in paths if self._there(p[len(self.folder) + 1 :])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", f"{self.folder}/{name}").schema(T.StructType([*schema.fields, T.StructField("ob", T.IntegerType())])).parquet(*paths)
        return found.where("owner is not null").select(schema.names)

    def table(self, name: str) -> DataFrame:
        """``rows`` that count, or ``hours``."""
        return self._read(name).where("not deleted") if name == "rows" else self._read(name)

    def pending(self) -> DataFrame:
        """``(owner, source, local_date, arrived)``: marks that no rebuild has taken yet."""
        kind = "owner long, source string, local_date date, arrived double"
        if not self._names("marks"):
            return self.spark.createDataFrame([], kind)
        marks = self.spark.read.schema(kind).parquet(f"{self.folder}/marks/*")
        if not self._names("consumed"):
            return marks
        gone = self.spark.read.schema("owner long, source string, local_date date, upto double").parquet(f"{self.folder}/consumed/*").groupBy(*DAY).agg(F.max("upto").alias("upto"))
        return marks.join(gone, DAY, "left").where("upto is null or arrived > upto").select(*DAY, "arrived")

    def _parts(self, days: DataFrame) -> list[tuple[int, str]]:
        """The parts of ``days(owner, local_date)``: as many as there are folders of them, at most."""
        return sorted((r.ob, str(r.local_date)) for r in days.select(self._bucket(), "local_date").distinct().collect())

    def _replace(self, name: str, df: DataFrame, parts: list[tuple[int, str]]) -> None:
        """Replace ``parts`` by the rows of ``df``, all of which are in one of them."""
        if not parts:
            return
        schema = self._schema(name)
        whole = df.select(*schema.names, self._bucket())
        keep = self.spark.createDataFrame(parts, "ob int, _d string").select("ob", F.to_date("_d").alias("local_date"))
        nulls = keep.select(*[F.col(c) if c == "local_date" else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names], "ob")
        both = whole.union(nulls).repartition("ob", "local_date")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ob", "local_date").parquet(f"{self.folder}/{name}")

    # batches

    def _known(self, keys: DataFrame) -> DataFrame:
        """``(key, owner, local_date)`` of the stored rows of ``keys(key, kb)``, from the buckets of the index that they are in."""
        kind = "key string, owner long, local_date date"
        buckets = sorted(r.kb for r in keys.select("kb").distinct().collect())  # KEYS at most
        paths = [f"{self.folder}/index/kb={b}" for b in buckets if self._there(f"index/kb={b}")]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*paths)

    def apply(self, batch: DataFrame, number: int | None = None) -> None:
        """One batch: versions, index and marks; ``number`` is what a stream counts by, and isn't used."""
        with self._alone(), released():
            self._recover()
            held = Scratch(self.spark, "batch").save(batch.select(*[f.split()[0] for f in ROW.split(", ")]))
            name = self.name_of("rows", held)
            if self._there(f"done/{name}"):
                return
            self._plan_rows(held, name)
            self._finish(name)
        if not self.settle:
            self.rebuild()

    def _plan_rows(self, batch: DataFrame, name: str) -> None:
        scratch = Scratch(self.spark, "plan")
        kb = F.pmod(F.xxhash64("key"), F.lit(self.KEYS)).cast("int").alias("kb")
        new = scratch.save(last_of_batch(batch).select("*", kb))
        known = scratch.save(self._known(new))
        met = known.join(new.select("key"), "key", "left_semi")
        parts = self._parts(met.select("owner", "local_date").union(new.select("owner", "local_date")))
        after, marks = merged(self._read("rows", parts), batch)
        after, marks = scratch.save(after.select(self.rows_schema.names)), scratch.save(marks)
        own = after.join(new.select("key"), "key", "left_semi").select("key", "owner", "local_date")
        index = known.join(new.select("key"), "key", "left_anti").unionByName(own)
        plan = f"{self.folder}/plan/{name}"
        self._delete(f"plan/{name}")
        after.write.parquet(f"{plan}/rows")
        index.select("*", kb).write.parquet(f"{plan}/index")
        marks.withColumn("arrived", F.lit(self.clock())).write.parquet(f"{plan}/marks")
        self.spark.createDataFrame([(b, d) for b, d in parts], "ob int, local_date string").write.parquet(f"{plan}/parts")
        self._touch(f"plan/{name}/ready")

    # rebuilds

    def rebuild(self, now: float | None = None) -> int:
        """Hours of all marked days whose marks have settled; the number of runs of days that it took."""
        runs = 0
        while True:
            with self._alone(), released():
                self._recover()
                name = self._plan_hours(self.clock() if now is None else now)
            if name is None:
                return runs
            with self._alone():
                self._recover()
            runs += 1

    def _plan_hours(self, now: float) -> str | None:
        scratch = Scratch(self.spark, "hours")
        due = scratch.save(self.pending().where(F.col("arrived") <= now - self.settle))
        first = due.agg(F.min("local_date")).first()[0]
        if first is None:
            return None
        taken = scratch.save(due.where(F.col("local_date") < F.date_add(F.lit(first), self.RUN)).groupBy(*DAY).agg(F.max("arrived").alias("upto")))
        days = scratch.save(widened(taken))
        parts = self._parts(days)
        rows = self._read("rows", self._parts(widened(days)))
        hours = rebuilt(self._read("hours", parts).select(self.hours_schema.names), rows, taken.select(*DAY), self.interval)
        name = f"hours-{uuid.uuid4().hex}"
        plan = f"{self.folder}/plan/{name}"
        hours.write.parquet(f"{plan}/hours")
        taken.write.parquet(f"{plan}/consumed")
        self.spark.createDataFrame(parts, "ob int, local_date string").write.parquet(f"{plan}/parts")
        self._touch(f"plan/{name}/ready")
        return name

    # what a plan does

    def _finish(self, name: str) -> None:
        plan = f"{self.folder}/plan/{name}"
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{plan}/{part}")
        parts = [(r.ob, r.local_date) for r in read("parts", "ob int, local_date string").collect()]
        if name.startswith("rows"):
            self._replace("rows", read("rows", self.rows_schema), parts)
            index = read("index", "key string, owner long, local_date date, kb int")
            index.repartition("kb").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb").parquet(f"{self.folder}/index")
            read("marks", "owner long, source string, local_date date, arrived double").write.mode("overwrite").parquet(f"{self.folder}/marks/{name}")
            self._touch(f"done/{name}")
        else:
            self._replace("hours", read("hours", self.hours_schema), parts)
            read("consumed", "owner long, source string, local_date date, upto double").write.mode("overwrite").parquet(f"{self.folder}/consumed/{name}")
        self._delete(f"plan/{name}")

    def compact(self) -> None:
        """Marks that wait in one file, and those taken forgotten."""
        with self._alone(), released():
            self._recover()
            old = [f"marks/{n}" for n in self._names("marks")] + [f"consumed/{n}" for n in self._names("consumed")]
            left = Scratch(self.spark, "compact").save(self.pending())
            left.coalesce(1).write.parquet(f"{self.folder}/marks/left-{uuid.uuid4().hex}")
            # a mark that is read twice for a while is built twice; one that is lost would never be
            for name in sorted(old, reverse=True):
                self._delete(name)


def run(store: Store, inbox: str, checkpoint: str, per_batch: int = 1) -> StreamingQuery:
    """A stream over JSON files that arrive in ``inbox``, every micro-batch applied to the store; ends when there is nothing left."""
    stream = store.spark.readStream.schema(ROW).option("maxFilesPerTrigger", per_batch).json(inbox)
    apply: Callable[[DataFrame, int], None] = store.apply
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
