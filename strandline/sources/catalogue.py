"""Metrics with what decides how they are resolved, and rule documents made of tables of ladders.

Both are data of the user's: the metrics here are those of the shared tables' stand-ins, and a ladder is a
table with a row for each group, which ``documents`` turns into rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.rules import VERSION

SCHEMA = "code string, agg string, reading string, provider_scoped boolean, selection_only boolean, derived_from string"
# Code, class, kind of reading, whether a score of one provider, whether never pooled, metric that it is derived from.
METRICS = (
    ("pulse", "intensive", None, False, False, None),
    ("pulse_low", "intensive", None, False, False, "pulse"),
    ("clicks", "additive", None, False, False, None),
    ("level", "latest", None, False, False, None),
    ("total", "daily_summary", None, False, True, None),
    ("view_score", "intensive", None, True, True, None),
    ("bp_systolic", "latest", "bp_reading", False, False, None),
    ("bp_diastolic", "latest", "bp_reading", False, False, None),
    ("sleep_total", "sleep_derived", None, False, False, None),
    ("sleep_deep", "sleep_derived", None, False, False, None),
)


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, SCHEMA)


def documents(ladders: DataFrame, more: Column | None = None) -> DataFrame:
    """``(rule, owner, metric, doc)`` of ``ladders(rule, owner, metric, window, op, pos, group, match array<map<string,string>>)``, a row for each group.

    ``more``: a struct of further fields of a rule, over the columns of ``ladders``, the same for all rows of a rule.
    """
    group = F.struct("pos", F.struct(F.col("group").alias("id"), "match").alias("g"))
    extra = more if more is not None else F.struct(F.lit(None).cast("string").alias("follow"))
    one = ladders.groupBy("rule", "owner", "metric").agg(F.first("window").alias("w"), F.first("op").alias("op"), F.first(extra).alias("x"), F.transform(F.array_sort(F.collect_list(group), lambda a, b: F.signum(a["pos"] - b["pos"]).cast("int")), lambda s: s["g"]).alias("groups"))
    body = F.struct(F.lit(VERSION).alias("schema"), "metric", F.struct(F.col("w").alias("kind")).alias("window"), "groups", F.struct("op").alias("strategy"), "x.*")
    return one.select("rule", "owner", "metric", F.to_json(body).alias("doc"))
