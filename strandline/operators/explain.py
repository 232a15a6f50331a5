"""Sentences that say how a value came about, from the columns of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences by what happened.
DIRECT = "The value comes from %s, the first source of the rule."
FALLBACK = "The value comes from %s, because %s had no usable data."
POOLED = "The value combines %s sources."
NOTHING = "No source had usable data."
SET = "The value was set by hand; the rule gives %s."
FORCED = "%s was chosen by hand; the rule gives %s."
PARTIAL = "The window hasn't ended yet."
FEW = "Fewer sources than the rule asks for were there."
HOURS = "The day was put together from %s hours."


def number(value: Column) -> Column:
    """A value as it is read: up to two decimals, or a dash."""
    return F.coalesce(F.regexp_replace(F.format_number(F.round(F.round(value, 6), 2), 2), r"[.]?0+$", ""), F.lit("–"))


def explanation(status: Column, selected: Column, skipped: Column, sources: Column, override: Column, computed: Column, partial: Column, few: Column, hours: Column) -> Column:
    """One text: what decided the value first, then what else is to be known."""
    main = (
        F.when(override == "set_value", F.format_string(SET, number(computed))).when(override == "force_source", F.format_string(FORCED, selected, number(computed))).when(status == "no_data", F.lit(NOTHING))
        .when(status == "calculated", F.format_string(POOLED, sources.cast("string"))).when(status == "fallback", F.format_string(FALLBACK, selected, F.array_join(skipped, ", "))).otherwise(F.format_string(DIRECT, selected))
    )
    more = F.array_compact(F.array(main, F.when(hours.isNotNull(), F.format_string(HOURS, hours.cast("string"))), F.when(few, F.lit(FEW)), F.when(partial, F.lit(PARTIAL))))
    return F.array_join(more, " ")


# Sentences on windows that were resolved by compiled rules; %s is a group.
TAKEN = {"direct": "Taken from %s, the first choice.", "fallback": "Taken from %s.", "overridden": "Taken from %s by hand."}
WHY_NOT = {
    "no_data": "%s has nothing here.", "implausible": "What %s has is out of range.", "flagged": "%s has flagged rows only.", "below_coverage": "%s covers too little of the window.", "stale": "What %s has is too old.", "not_worn": "%s wasn't worn.", "partial_episode": "%s saw too little of the night.",
}
CONTEXTS = {"workout": "A workout changes the order of sources.", "sleep": "The night's order of sources applies."}
NOTES = {
    "insufficient_sources": "There are fewer sources than the rule asks for.", "cross_source_sum": "Sources are added up, so the same may count twice.", "composite_exceeds_any_source": "The hours of several sources make more than any one of them has.",
    "definition_changed": "Another source than in the window before: the two may not compare.", "follow_unavailable": "The source of the leading metric can't be used here.",
}


def _texts(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def windows(results: DataFrame, groups: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """``(keys, explanation)`` of resolved windows: where the value is from, why each preferred group isn't, what wasn't needed, and what else to mind.

    ``results(keys, value, selected, status, context, warnings, end)`` and ``groups(keys, group, ladder, reason, status)`` as
    the compiler gives them; an ``override`` column (set_value, force_source), if there is one, with ``computed``, comes first.
    Groups are told in the order of the window's ladder; a window that isn't over by ``now`` says so.
    """
    g = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ladder", "group", "reason", "status"))).alias("_g"))
    r = results.join(g, keys, "left").withColumn("_g", F.coalesce("_g", F.array().cast(g.schema["_g"].dataType)))
    won = F.size(F.filter("_g", lambda x: x["status"] == "selected"))
    place = F.get(F.filter("_g", lambda x: x["group"] == F.col("selected")), F.lit(0))["ladder"]
    main = F.when(F.col("status") == "no_data", F.lit("No source can be used.")).when(F.col("status") == "calculated", F.format_string("%s sources combined.", won.cast("string"))).otherwise(F.replace(_texts(TAKEN)[F.col("status")], F.lit("%s"), F.col("selected")))
    if "override" in results.columns:
        main = F.when(F.col("override") == "set_value", F.format_string(SET, number(F.col("computed")))).otherwise(main)
    r = r.withColumn("_place", place)
    missing = F.filter("_g", lambda x: x["reason"].isNotNull() & (F.col("_place").isNull() | (x["ladder"] < F.col("_place"))))
    why = F.transform(missing, lambda x: F.replace(F.coalesce(_texts(WHY_NOT)[x["reason"]], F.lit("%s can't be used.")), F.lit("%s"), x["group"]))
    spare = F.transform(F.filter("_g", lambda x: x["status"] == "unused"), lambda x: x["group"])
    notes = F.array_compact(F.transform("warnings", lambda w: _texts(NOTES)[F.split_part(w, F.lit(":"), F.lit(1))]))
    open_ = F.when(F.col("end") > now, "The window is still open.") if now is not None else F.lit(None).cast("string")
    parts = F.concat(F.array(main), why, F.array(F.when(F.size(spare) > 0, F.concat(F.lit("Not needed: "), F.array_join(spare, ", "), F.lit("."))), _texts(CONTEXTS)[F.col("context")]), notes, F.array(open_))
    return r.select(*keys, F.array_join(F.array_compact(parts), " ").alias("explanation"))
