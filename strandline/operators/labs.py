"""Laboratory results: units brought to one per analyte, labels matched, rows checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import ambiguous_date, comparator, match_key, numbers_of, range_of, unit_key


def canonical(rows: DataFrame, analytes: DataFrame, units: DataFrame) -> DataFrame:
    """``rows(code, value, unit)`` with ``state`` and ``result``.

    ``analytes(code, canonical_unit)`` and ``units(code, unit_key, factor, offset)`` are lists that
    Spark broadcasts if their size allows: canonical, convertible, refused (a unit of another quantity), or unknown (no such analyte).
    """
    a = rows.join(analytes, "code", "left").withColumn("unit_key", unit_key(F.col("unit")))
    a = a.join(units, ["code", "unit_key"], "left")
    same = F.col("unit_key") == unit_key(F.col("canonical_unit"))
    state = F.when(F.col("canonical_unit").isNull(), "unknown").when(same, "canonical").when(F.col("factor").isNotNull(), "convertible").otherwise("refused")
    result = F.when(state == "canonical", F.col("value")).when(state == "convertible", F.col("value") * F.col("factor") + F.col("offset"))
    return a.withColumn("state", state).withColumn("result", result).drop("factor", "offset", "canonical_unit", "unit_key")


def suggest(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``labels(owner, label)`` with the ``code`` of the analyte that a label names: the owner's alias beats one that all share."""
    key = F.lower(F.trim("label"))
    met = labels.withColumn("_k", key).select("owner", "_k").distinct().join(aliases.withColumnRenamed("owner", "_o"), (F.col("_k") == F.col("label_key")) & (F.col("_o").isNull() | (F.col("_o") == F.col("owner"))))
    best = met.groupBy("owner", "_k").agg(F.min_by("code", F.struct(F.col("_o").isNull(), "code")).alias("code"))
    return labels.withColumn("_k", key).join(best, ["owner", "_k"], "left").drop("_k")


def warnings(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``rows(id, code, date, value, low, high)`` with an array of what to look at."""
    # rows without a code never repeat one another, and don't meet in one window
    twice = F.count("*").over(Window.partitionBy("code", "date", F.when(F.col("code").isNull(), F.col("id")))) > 1
    known = confirmed.select("code", "date").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_twice", twice).join(known, ["code", "date"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("code").isNull(), "no_analyte"), F.when(F.col("value").isNull(), "no_value"), F.when(F.col("date").isNull(), "no_date"),
        F.when(F.col("low") > F.col("high"), "range_reversed"), F.when(F.col("value") < F.col("low"), "below_range"), F.when(F.col("value") > F.col("high"), "above_range"),
        F.when(F.col("_twice") & F.col("code").isNotNull(), "repeated_in_run"), F.when(F.col("_known"), "already_confirmed"),
    ))
    return out.withColumn("warnings", found).drop("_twice", "_known")


def confirm(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(id, keys, value, factor)`` as results: of rows that say the same thing twice the first is confirmed; ``result`` is in the canonical unit."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("id"))
    return rows.join(first, ["id", *keys]).withColumn("result", F.col("value") / F.col("factor")).withColumn("revision", F.lit(1)).withColumn("active", F.lit(True))


def unconfirm(results: DataFrame, taken_back: DataFrame) -> DataFrame:
    """``results`` with another revision for those that are taken back; nothing is deleted."""
    gone = taken_back.select("id").distinct().withColumn("_gone", F.lit(True))
    out = results.join(gone, "id", "left")
    return out.withColumn("revision", F.when(F.col("_gone"), F.col("revision") + 1).otherwise(F.col("revision"))).withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def inventory(results: DataFrame) -> DataFrame:
    """``(code, n, first, last, latest, days)`` of confirmed results, the most recent analyte first."""
    by_day = results.groupBy("code", "date").agg(F.count("*").alias("_n"), F.max_by("result", "id").alias("_v"))
    out = by_day.groupBy("code").agg(F.sum("_n").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("_v", "date").alias("latest"), F.count("date").alias("days"))
    return out.orderBy(F.col("last").desc_nulls_last(), "code")


#: Warnings in the order in which they are listed.
WARNINGS = (
    "value_mismatch", "comparator_mismatch", "range_mismatch", "evidence_unverified", "value_not_in_evidence", "unknown_unit", "unit_not_convertible", "unit_missing", "date_missing", "date_in_future",
    "date_ambiguous", "reported_before_collected", "duplicate_in_run", "already_confirmed", "unknown_analyte",
)


def transcription_warnings(rows: DataFrame, confirmed: DataFrame, now: Column) -> DataFrame:
    """``rows`` with an array of what is odd about how a row was read, never about the value itself.

    ``rows(id, analyte, value, value_text, comparator, low, high, range_text, evidence, page_text, unit_state,
    collected, reported, date_text, rejected)``; ``unit_state`` as of ``canonical``, null where there is no unit.
    """
    key = ["analyte", "collected"]
    twice = F.count_if(~F.col("rejected")).over(Window.partitionBy(*key))
    known = confirmed.select(*key).distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_twice", twice).join(known, key, "left")
    low, high = range_of(F.col("range_text"))
    close = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.lit(1.0))
    read = numbers_of(F.col("value_text"))
    c = F.col
    found = F.array_compact(F.array(
        F.when(c("value").isNotNull() & (F.size(read) > 0) & ~F.exists(read, lambda x: close(x, c("value"))), WARNINGS[0]), F.when(c("value_text").isNotNull() & ~c("comparator").eqNullSafe(comparator(c("value_text"))), WARNINGS[1]),
        F.when(c("range_text").isNotNull() & ~(c("low").eqNullSafe(low) & c("high").eqNullSafe(high)), WARNINGS[2]), F.when((match_key(c("page_text")) != "") & ~F.contains(match_key(c("page_text")), match_key(c("evidence"))), WARNINGS[3]),
        F.when((match_key(c("value_text")) != "") & ~F.contains(match_key(c("evidence")), match_key(c("value_text"))), WARNINGS[4]), F.when(c("analyte").isNotNull() & (c("unit_state") == "unknown"), WARNINGS[5]), F.when(c("analyte").isNotNull() & (c("unit_state") == "refused"), WARNINGS[6]),
        F.when(c("analyte").isNotNull() & c("value").isNotNull() & c("unit_state").isNull(), WARNINGS[7]), F.when(c("collected").isNull(), WARNINGS[8]), F.when((c("collected") > F.date_add(now, 1)) | (c("reported") > F.date_add(now, 1)), WARNINGS[9]),
        F.when(ambiguous_date(c("date_text")), WARNINGS[10]), F.when(c("reported") < c("collected"), WARNINGS[11]), F.when(c("analyte").isNotNull() & ~c("rejected") & (c("_twice") > 1), WARNINGS[12]), F.when(c("analyte").isNotNull() & c("_known"), WARNINGS[13]), F.when(c("analyte").isNull(), WARNINGS[14]),
    ))
    return out.withColumn("warnings", found).drop("_twice", "_known")
