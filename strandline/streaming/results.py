"""Results that are kept: read again without resolving, dropped where something that they read has changed.

A result is kept under its owner, metric, window kind and date, the rule that it came from and a fingerprint
of what people overrode; another rule or another override is another key, so that nothing stale is read.
A key without any window is kept too.  What a change reaches is a set of date ranges for each owner and
metric, merged from six kinds of changes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.scratch import Scratch, released

KEY = ["owner", "metric", "kind", "local_date", "rule_ref", "fp"]
#: Dates that stand for no beginning and no end.
ALWAYS = ("0001-01-01", "9999-12-31")


def fingerprints(overrides: DataFrame, content: list[str]) -> DataFrame:
    """``(owner, metric, local_date, fp)``: a digest of the overrides of a day that doesn't depend on their order; days without any have none."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *content).cast("decimal(38,0)")).cast("string")
    return overrides.groupBy("owner", "metric", "local_date").agg(F.concat_ws("/", F.count("*").cast("string"), h(1), h(2)).alias("fp"))


class ResultCache:
    """Results in a folder, cut by metric, kind, owner bucket and date; a read writes the parts of what it missed."""

    PARTS = ["metric", "kind", "ob", "local_date"]

    def __init__(self, spark: SparkSession, folder: str, schema: str, owners: int = 16) -> None:
        """``schema``: columns of a result besides its key; ``window_end`` (microseconds) is one of them, and ``window_key``, null for a key without windows.

        ``owners``: buckets of owners in a date.  Results without an owner are never kept.
        """
        self.spark, self.folder, self.owners = spark, folder.rstrip("/"), owners
        key = "owner long, metric string, kind string, local_date date, rule_ref string, fp string"
        self.schema = spark.createDataFrame([], f"{key}, {schema}").schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("owner"), F.lit(self.owners)).cast("int").alias("ob")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001

    def entries(self, parts: list[tuple] | None = None) -> DataFrame:
        """All that is kept, or what is in the given parts; parts that were emptied hold a row without an owner."""
        paths = [self.folder] if parts is None else [self.folder + "/" + "/".join(f"{c}={v}" for c, v in zip(self.PARTS, p)) for p in parts]
        paths = [p for p in paths if self._there(p)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        wide = T.StructType([*self.schema.fields, T.StructField("ob", T.IntegerType())])
        return self.spark.read.option("basePath", self.folder).schema(wide).parquet(*paths).where("owner is not null").select(self.schema.names)

    def _touched(self, keys: DataFrame) -> list[tuple]:
        return [tuple(r) for r in keys.select("metric", "kind", self._bucket(), F.col("local_date").cast("string").alias("local_date")).distinct().collect()]

    def _replace(self, rows: DataFrame, parts: list[tuple]) -> None:
        nulls = self.spark.createDataFrame(parts, "metric string, kind string, ob int, _d string").withColumn("local_date", F.to_date("_d"))
        nulls = nulls.select(*[F.col(f.name) if f.name in self.PARTS else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "ob")
        whole = rows.select(*self.schema.names, self._bucket()).union(nulls).repartition(*self.PARTS)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.PARTS).parquet(self.folder)

    def read(self, wanted: DataFrame, resolve: Callable[[DataFrame], DataFrame], now: int, marks: DataFrame | None = None) -> DataFrame:
        """Results of the keys ``wanted(KEY)``: those kept as they are, the others by ``resolve``, which gets the missing keys alone.

        New results are kept if all windows of their key have ended by ``now`` and no mark of
        ``marks(owner, local_date)`` waits on their date.  If nothing is missing, nothing is resolved.
        """
        scratch = Scratch(self.spark, "cached")
        wanted = scratch.save(wanted.select(KEY).distinct())
        parts = self._touched(wanted)
        kept = self.entries(parts)
        same = [wanted[c].eqNullSafe(kept[c]) for c in KEY]
        hits = scratch.save(kept.join(wanted, reduce(lambda a, b: a & b, same), "left_semi"))
        have = hits.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
        missed = scratch.save(wanted.join(have, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]), "left_anti"))
        if missed.isEmpty():
            return hits.where("window_key is not null")
        new = resolve(missed).select([c for c in self.schema.names])
        m = missed.select(*[F.col(c).alias(f"_{c}") for c in KEY])
        full = m.join(new, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]), "left")
        rest = [c for c in self.schema.names if c not in KEY]
        full = scratch.save(full.select(*[F.col(f"_{c}").alias(c) for c in KEY], *rest))
        self._keep(full, now, marks)
        return hits.unionByName(full).where("window_key is not null")

    def _keep(self, new: DataFrame, now: int, marks: DataFrame | None) -> None:
        closed = new.groupBy(*KEY).agg(F.max(F.coalesce("window_end", F.lit(0))).alias("_end")).where(F.col("_end") <= now)
        if marks is not None:
            closed = closed.join(marks.select("owner", "local_date").distinct(), ["owner", "local_date"], "left_anti")
        ok = closed.select(*[F.col(c).alias(f"_{c}") for c in KEY])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
        with released():
            fresh = Scratch(self.spark, "keep").save(new.join(ok, same, "left_semi"))
            parts = self._touched(fresh)
            if parts:
                whole = Scratch(self.spark, "keep").save(self.entries(parts).unionByName(fresh))
                self._replace(whole, parts)

    def invalidate(self, ranges: DataFrame) -> None:
        """Drop what ``ranges(owner, metric, lo, hi)`` reach, dates included."""
        with released():
            scratch = Scratch(self.spark, "invalid")
            r = ranges.select(F.col("owner").alias("_o"), F.col("metric").alias("_m"), "lo", "hi")
            hit = (F.col("owner") == F.col("_o")) & (F.col("metric") == F.col("_m")) & F.col("local_date").between(F.col("lo"), F.col("hi"))
            gone = scratch.save(self.entries().join(r, hit, "left_semi").select(KEY).distinct())
            parts = self._touched(gone)
            if parts:
                g = gone.select(*[F.col(c).alias(f"_{c}") for c in KEY])
                same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY])
                self._replace(scratch.save(self.entries(parts).join(g, same, "left_anti")), parts)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """``(owner, metric, lo, hi)``: the union of date ranges of each owner and metric, ranges that touch or overlap made one."""
    w = Window.partitionBy("owner", "metric").orderBy("lo", "hi")
    far = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("lo") > F.date_add(far, 1)).cast("int")
    cut = ranges.distinct().withColumn("_new", F.when(far.isNull(), 1).when(far == F.lit(ALWAYS[1]).cast("date"), 0).otherwise(new))
    cut = cut.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("owner", "metric", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _always(which: int) -> Column:
    return F.lit(ALWAYS[which]).cast("date")


def of_marks(marks: DataFrame, reaches: DataFrame) -> DataFrame:
    """Rows that came late, changed or went: ``marks(owner, dep, local_date)`` reach the metrics that read ``dep``, so many days back and ahead."""
    m = marks.join(reaches, "dep")
    return m.select("owner", "metric", F.date_sub("local_date", F.col("after")).alias("lo"), F.date_add("local_date", F.col("before")).alias("hi"))


def of_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """Another active rule ``(owner, metric, rule_ref)``, or none, or a first one: all dates of the metric."""
    a, b = before.select("owner", "metric", F.col("rule_ref").alias("_a")), after.select("owner", "metric", F.col("rule_ref").alias("_b"))
    return a.join(b, ["owner", "metric"], "full").where("not (_a <=> _b)").select("owner", "metric", _always(0).alias("lo"), _always(1).alias("hi"))


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one state has and the other lacks."""
    return before.exceptAll(after).union(after.exceptAll(before))


def of_workouts(before: DataFrame, after: DataFrame, metrics: DataFrame) -> DataFrame:
    """Workouts ``(owner, <anything>, first_date, last_date)`` that were added, changed or removed: their dates and the days beside, for ``metrics(metric)`` with contexts."""
    d = _changed(before, after.select(before.columns)).select("owner", F.date_sub("first_date", 1).alias("lo"), F.date_add("last_date", 1).alias("hi"))
    return _for_all(d, metrics)


def of_zones(changed: DataFrame, metrics: DataFrame) -> DataFrame:
    """Timelines whose zone differs within ``changed(owner, lo, hi)`` (microseconds): the dates of that time in any zone."""
    day = lambda c: F.when(F.col(c) <= -(1 << 61), _always(0)).when(F.col(c) >= 1 << 61, _always(1)).otherwise(F.to_date(F.timestamp_micros(F.least(F.greatest(F.col(c), F.lit(-(1 << 55))), F.lit(1 << 55)))))
    lo, hi = day("lo"), day("hi")
    d = changed.select("owner", F.when(lo == _always(0), lo).otherwise(F.date_sub(lo, 1)).alias("lo"), F.when(hi == _always(1), hi).otherwise(F.date_add(hi, 1)).alias("hi"))
    return _for_all(d, metrics)


def of_sources(before: DataFrame, after: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Devices or origins ``(owner, key, <attributes>)`` whose attributes changed: the dates of their rows ``seen(owner, key, metric, local_date)``."""
    d = _changed(before, after.select(before.columns)).select("owner", key).distinct()
    span = seen.groupBy("owner", key, "metric").agg(F.min("local_date").alias("lo"), F.max("local_date").alias("hi"))
    return span.join(d, ["owner", key], "left_semi").select("owner", "metric", "lo", "hi")


def _for_all(dates: DataFrame, metrics: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(r.metric) for r in metrics.select("metric").distinct().orderBy("metric").collect()])  # the catalogue's codes
    return dates.select("owner", F.explode(names).alias("metric"), "lo", "hi")
