"""Across groups: gates, ladders, pools, followers, hours put together, and what people set by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORST, BEST = "unused", "selected"


def spine(windows: DataFrame, groups: int) -> DataFrame:
    """Every window with every place of the ladder, so that a group without rows is listed too."""
    return windows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def gates(values: DataFrame, low: float | None = None, high: float | None = None, least_coverage: float | None = None, at: Column | None = None, not_before: Column | None = None, additive: bool = True) -> DataFrame:
    """``values`` with ``reason`` (null: valid): no rows, then the range of an additive sum, then coverage, then age.

    Columns ``implausible`` and ``flagged``, if there are any, count the rows that the row gates took: a
    group left with nothing by them says so.
    """
    lost = [F.when(F.col("value").isNull() & (F.col(c) > 0), c) for c in ("implausible", "flagged") if c in values.columns]
    reason = F.coalesce(*lost, F.when(F.col("value").isNull(), "no_data"))
    if additive and low is not None and high is not None and high > low:
        reason = F.coalesce(reason, F.when(~F.col("value").between(low, high), "implausible"))
    if least_coverage is not None:
        reason = F.coalesce(reason, F.when(F.col("coverage") < least_coverage, "below_coverage"))
    if at is not None and not_before is not None:
        reason = F.coalesce(reason, F.when(at < not_before, "stale"))
    return values.withColumn("reason", reason)


def group_status(reason: Column) -> Column:
    """Status of a group from the reason of its gate."""
    return F.when(reason.isNull(), "valid").when(reason == "no_data", "no_data").when(reason == "stale", "stale").otherwise("below_quality")


def _valid() -> Column:
    return F.col("reason").isNull()


def first_available(values: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, value, selected, status, skipped)`` of the first valid group of each window; the ``skipped`` ones stand before it."""
    pos = F.when(_valid(), F.col("pos"))
    picked = values.groupBy(*keys).agg(F.min(pos).alias("selected"), F.min_by(F.when(_valid(), F.col("value")), pos).alias("value"))
    status = F.when(F.col("selected").isNull(), "no_data").when(F.col("selected") == 0, "direct").otherwise("fallback")
    return picked.select(*keys, "value", "selected", status.alias("status"), F.coalesce("selected", F.lit(0)).alias("skipped"))


def _newest(newest: bool) -> Column:
    order = F.struct("at", -F.col("pos")) if newest else F.struct("first", "pos")
    return (F.max_by if newest else F.min_by)(F.struct("value", "pos"), F.when(_valid(), order))


def by_time(values: DataFrame, keys: list[str], newest: bool = True) -> DataFrame:
    """``(keys, value, selected)`` of the group whose rows reach latest (or start earliest); ties stay with the earlier group; null where no group is valid."""
    return values.groupBy(*keys).agg(_newest(newest).alias("r")).select(*keys, "r.value", F.col("r.pos").alias("selected"))


POOLS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def pools(values: DataFrame, keys: list[str], how: dict[str, str], least: int = 1, use_available: bool = True) -> DataFrame:
    """``(keys, <name of each pool>, sources, status, warning)`` over the valid groups of every window, in one aggregation.

    With fewer than ``least`` of them the warning is ``insufficient_sources``, and the value what there
    is or, without ``use_available``, none.  A window without a valid group is listed without a value.
    """
    each = [POOLS[f](F.when(_valid(), F.col("value"))).alias(name) for name, f in how.items()]
    out = values.groupBy(*keys).agg(*each, F.count_if(_valid()).alias("sources"))
    few = (F.col("sources") > 0) & (F.col("sources") < least)
    if not use_available:
        out = out.withColumns({name: F.when(~few, F.col(name)) for name in how})
    there = F.col("sources") > 0 if use_available else F.col("sources") >= least
    return out.withColumn("status", F.when(there, "calculated").otherwise("no_data")).withColumn("warning", F.when(few, "insufficient_sources"))


def pool(values: DataFrame, keys: list[str], how: str, least: int = 1, use_available: bool = True) -> DataFrame:
    """``pools`` of one kind, as ``value``."""
    return pools(values, keys, {"value": how}, least, use_available)


def across(values: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, latest, latest_pos, earliest, earliest_pos)`` in one aggregation."""
    out = values.groupBy(*keys).agg(_newest(True).alias("l"), _newest(False).alias("e"))
    return out.select(*keys, F.col("l.value").alias("latest"), F.col("l.pos").alias("latest_pos"), F.col("e.value").alias("earliest"), F.col("e.pos").alias("earliest_pos"))


def definition_changed(resolved: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``resolved`` with ``changed``: the window before selected another group (none if it selected nothing)."""
    before = F.lag("selected").over(Window.partitionBy(*keys).orderBy(order))
    return resolved.withColumn("changed", F.coalesce((before != F.col("selected")), F.lit(False)))


def follow(values: DataFrame, leader: DataFrame, keys: list[str], own: DataFrame | None = None) -> DataFrame:
    """``(keys, value, selected, status, warning)``: the leader's group where it is valid here, else the own strategy.

    ``own(keys, value, selected, status)`` is what the rule gives without a leader, the first available
    group if not given.  Where the leader's group can't be followed, or the leader selected none, a result that
    would be direct is a fallback, a pool stays calculated, and the warning is ``follow_unavailable``.
    """
    own = (first_available(values, keys) if own is None else own).select(*keys, "value", "selected", F.col("status").alias("_own"))
    led = leader.select(*keys, F.col("selected").alias("_led"))
    there = values.where("reason is null").select(*keys, F.col("pos").alias("_led"), F.col("value").alias("_v"))
    out = own.join(led, keys, "left").join(there, [*keys, "_led"], "left")
    ok = F.col("_v").isNotNull()
    status = F.when(ok, "direct").when(F.col("_own") == "direct", "fallback").otherwise(F.col("_own"))
    return out.select(*keys, F.when(ok, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(ok, F.col("_led")).otherwise(F.col("selected")).alias("selected"), status.alias("status"), F.when(~ok, "follow_unavailable").alias("warning"))


def reorder(values: DataFrame, contexts: DataFrame, keys: list[str], orders: dict[str, list[int]]) -> DataFrame:
    """``values`` with ``pos`` as the order of the window's context has it; windows without a context keep the ladder."""
    out = values.join(contexts, keys, "left")
    place = F.col("pos")
    for context, order in orders.items():
        for new, old in enumerate(order):
            place = F.when((F.col("context") == context) & (F.col("pos") == old), F.lit(new)).otherwise(place)
    return out.withColumn("ladder", place)


RANKS = ("no_data", "stale", "below_quality", "unused", "selected")  # fixed values: a group's day has the best status of its hours


def compose(hours: DataFrame, keys: list[str], groups: int, op: str = "first_available") -> DataFrame:
    """Groups' hours ``(keys, hour, pos, value, reason, coverage, elapsed, day)`` composed to days, one row for each group.

    Only hours with rows come in: an hour that a group lacks counts as ``no_data`` with nothing covered, which its day's length
    ``day`` (that of all its hours, as ``elapsed`` is of one) tells without listing it.  Every hour picks its group: the first
    valid one, or the first of those with the largest value.  The
    result has, for each key and each of the ``groups``, ``group_status`` (the best of its hours), ``group_value`` (its own
    day), ``group_coverage`` (by elapsed time), ``supplied``, and for the day ``value``, ``hours``,
    ``groups``, ``selected``, ``status`` and ``exceeds``: several groups supplied hours, and the sum is more
    than any one of them would give.
    """
    valid = F.when(_valid(), F.col("pos"))
    order = F.struct("pos") if op == "first_available" else F.struct(-F.col("value"), "pos")
    w = Window.partitionBy(*keys, "hour")
    best = F.min_by("pos", F.when(_valid(), order)).over(w)
    # one shuffle by the day serves its hours, its groups and itself
    h = hours.repartition(*keys).withColumn("_sel", best)
    status = F.when(F.col("pos") == F.col("_sel"), 5).when(_valid(), 4).when(F.col("reason") == "no_data", 1).when(F.col("reason") == "stale", 2).otherwise(3)
    own = h.groupBy(*keys, "pos").agg(
        F.max(status).alias("_rank"), F.sum(F.when(_valid(), F.col("value"))).alias("group_value"), (F.sum(F.coalesce("coverage", F.lit(0.0)) * F.col("elapsed")) / F.first("day")).alias("group_coverage"),
        F.count_if(F.col("pos") == F.col("_sel")).alias("supplied"), F.sum(F.when(F.col("pos") == F.col("_sel"), F.col("value"))).alias("_part"),
        F.count_if((F.col("pos") == F.col("_sel")) & (F.col("pos") != (0 if op == "first_available" else -1))).alias("_later"),
    )
    supplied = F.col("supplied") > 0
    days = own.groupBy(*keys).agg(
        F.collect_list(F.struct("pos", "_rank", "group_value", "group_coverage", supplied.alias("supplied"))).alias("_own"), F.sum("_part").alias("value"), F.sum("supplied").alias("hours"), F.sum(supplied.cast("int")).alias("groups"),
        F.max(F.coalesce("group_value", F.lit(0.0))).alias("_most"), F.max(F.when(supplied, F.col("pos"))).alias("_one"), F.sum("_later").alias("_fall"),
    )
    direct = F.when(F.col("_fall") == 0, "direct").otherwise("fallback") if op == "first_available" else F.lit("fallback")
    state = F.when(F.col("hours") == 0, "no_data").when(F.col("groups") == 1, direct).otherwise("calculated")
    out = spine(days, groups).withColumn("_g", F.get(F.filter("_own", lambda g: g["pos"] == F.col("pos")), F.lit(0)))
    return out.select(
        *keys, "pos", F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.coalesce("_g._rank", F.lit(1))).alias("group_status"), "_g.group_value", F.coalesce("_g.group_coverage", F.lit(0.0)).alias("group_coverage"), F.coalesce("_g.supplied", F.lit(False)).alias("supplied"), "value", "hours", "groups",
        F.when(F.col("groups") == 1, F.col("_one")).alias("selected"), state.alias("status"), F.coalesce((F.col("groups") > 1) & (F.col("value") > F.col("_most") + 1e-9), F.lit(False)).alias("exceeds"),
    )


def daily_fallback(composed: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, value, selected, status, from_daily, skipped)``: a composed day, or the daily value of a group that has nothing else.

    ``daily(keys, pos, value)`` holds the valid daily values of groups without other rows.  The first of
    them counts if it stands before every group that supplied an hour; it is never added to hours, and the
    ``skipped`` groups before it were preferred and not available.
    """
    day = composed.groupBy(*keys).agg(F.max("value").alias("_v"), F.max("selected").alias("_s"), F.max("status").alias("_st"), F.min(F.when(F.col("supplied"), F.col("pos"))).alias("_p"))
    first = daily.groupBy(*keys).agg(F.min("pos").alias("_dp"), F.min_by("value", "pos").alias("_dv"))
    out = day.join(first, keys, "full")
    use = F.col("_dp").isNotNull() & (F.col("_p").isNull() | (F.col("_dp") < F.col("_p")))
    status = F.when(use, F.when(F.col("_dp") == 0, "direct").otherwise("fallback")).otherwise(F.col("_st"))
    return out.select(*keys, F.when(use, F.col("_dv")).otherwise(F.col("_v")).alias("value"), F.when(use, F.col("_dp")).otherwise(F.col("_s")).alias("selected"), status.alias("status"), use.alias("from_daily"), F.when(use, F.col("_dp")).otherwise(0).alias("skipped"))


def fallback_groups(composed: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pos, group_status)`` after ``daily_fallback``: groups that supplied hours of a day that is a daily value are unused, the daily group is selected."""
    d = decided.select(*keys, "from_daily", F.col("selected").alias("_sel"))
    own = composed.select(*keys, "pos", "group_status").join(d, keys, "left")
    status = F.when(F.col("from_daily") & (F.col("pos") == F.col("_sel")), "selected").when(F.col("from_daily") & (F.col("group_status") == "selected"), "unused").otherwise(F.col("group_status"))
    return own.select(*keys, "pos", status.alias("group_status"))


def exclude_inputs(rows: DataFrame, overrides: DataFrame, reading: list[str]) -> DataFrame:
    """``rows`` less the whole readings that an override names."""
    return rows.join(overrides.select(*reading).distinct(), reading, "left_anti")


def apply_overrides(resolved: DataFrame, values: DataFrame, forced: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """``resolved`` with a forced group, then a set value, applied; ``computed`` keeps what was resolved."""
    f = forced.select(*keys, F.col("pos").alias("_f"))
    v = values.where("reason is null").select(*keys, F.col("pos").alias("_f"), F.col("value").alias("_fv"))
    s = fixed.select(*keys, F.col("value").alias("_s"))
    out = resolved.withColumnRenamed("value", "computed").join(f, keys, "left").join(v, [*keys, "_f"], "left").join(s, keys, "left")
    kind = F.when(F.col("_s").isNotNull(), "set_value").when(F.col("_fv").isNotNull(), "force_source")
    return out.withColumn("value", F.coalesce("_s", "_fv", "computed")).withColumn("override", kind).drop("_f", "_fv", "_s")


def differences(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as they differ."""
    return stored.exceptAll(live).withColumn("side", F.lit("stored")).union(live.exceptAll(stored).withColumn("side", F.lit("live")))


def result_coverage(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, coverage)``: mean coverage of the groups that the value came from, 0 where there is none."""
    return groups.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("group_status") == "selected", F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def hours_coverage(hours: DataFrame, keys: list[str], start: Column, now: Column) -> DataFrame:
    """``(keys, coverage)`` of a composed day: mean over the hours that have begun."""
    return hours.groupBy(*keys).agg(F.coalesce(F.avg(F.when(start < now, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def sources_used(resolved: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``(keys, used)``: groups that values came from, in the order of their first use."""
    first = resolved.where("selected is not null").groupBy(*keys, "selected").agg(F.min(order).alias("_f"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "selected"))), lambda x: x["selected"]).alias("used"))


def preview(active: DataFrame, draft: DataFrame, keys: list[str]) -> DataFrame:
    """Two resolutions beside each other, with what a change of rule would do: same, changed, appears or vanishes."""
    a, b = active.select(*keys, F.col("value").alias("old"), F.col("selected").alias("old_selected")), draft.select(*keys, F.col("value").alias("new"), F.col("selected").alias("new_selected"))
    change = F.when(F.col("old").isNull() & F.col("new").isNull(), "same").when(F.col("old").isNull(), "appears").when(F.col("new").isNull(), "vanishes").when((F.abs(F.col("old") - F.col("new")) <= 1e-9) & F.col("old_selected").eqNullSafe(F.col("new_selected")), "same").otherwise("changed")
    return a.join(b, keys, "full").withColumn("change", change)


def warnings(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, warnings)``: for each group that stands before the selected one, that it was not available."""
    skipped = F.when(F.col("pos") < F.col("selected"), F.struct(F.col("pos").alias("pos"), F.lit("preferred_source_unavailable").alias("code")))
    return groups.groupBy(*keys).agg(F.array_sort(F.collect_list(skipped)).alias("warnings"))


def recorded_first(values: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` with ``ladder``: in a window with an event the group that ``recorded`` it stands first, the others keep their order."""
    out = values.join(events, keys, "left")
    return out.withColumn("ladder", F.when(F.col("pos") == F.col("recorded"), -1).otherwise(F.col("pos"))).drop("recorded")
