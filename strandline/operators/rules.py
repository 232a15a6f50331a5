"""Rule documents as rows: parsed by one schema, checked against the metric catalogue, and put in order of their leaders.

A rule is data, never code: it names groups of sources, a window, a strategy and gates.  Documents are JSON
texts in a column; every check is a column, so that a table of rules of any length is checked in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.windows import ALLOWED
from strandline.sources.scratch import Scratch

VERSION = "resolution-rule.v1"
RULE = (
    "schema string, metric string, window struct<kind:string,size:string>, groups array<struct<id:string,match:array<map<string,string>>>>, exclude array<map<string,string>>,"
    " within_source struct<intra_group:string,daily_value_policy:string,statistic:string,span:string>, strategy struct<op:string,min_sources:int,on_insufficient:string>,"
    " quality struct<min_coverage:double,plausible_range:array<double>,exclude_flags:array<string>,max_staleness:string,require_wear:string,sleep:struct<match_overlap:double,min_episode_coverage:double,include_naps:boolean,night_anchor:string>>,"
    " contexts map<string,array<string>>, follow string, compose struct<`from`:string,op:string>, acknowledged_warnings array<string>"
)
# Fields of a rule and of a selector, window kinds, bucket sizes, strategies, flags and warnings.
FIELDS = ("schema", "metric", "window", "groups", "exclude", "within_source", "strategy", "quality", "contexts", "follow", "compose", "acknowledged_warnings")
SELECTOR = ("provider", "connection_id", "origin_key", "origin_key_prefix", "origin_name", "relayed", "device_type", "device_model", "device_manufacturer", "device_id", "entry")
WINDOWS = ("bucket", "hour", "local_day", "local_night", "sleep_episode", "latest", "reading")
SIZES = ("30s", "1m", "5m", "15m", "30m")
POOLS = ("mean_across_sources", "minimum_across_sources", "maximum_across_sources", "sum_across_sources")
PICKS = ("single_source", "first_available", "latest", "earliest", "event_priority")
FLAGS = ("manual_entry", "motion_context", "implausible", "relayed", "migrated_without_raw", "prorated_source", "calibrating")
WARNINGS = ("cross_source_sum", "preferred_source_unavailable", "insufficient_sources", "definition_changed", "composite_exceeds_any_source", "follow_unavailable")
BUCKETED = ("intensive", "additive")
FAMILIES = {"sleep": "sleep_total", "blood_pressure": "bp_systolic"}


def parsed(docs: DataFrame) -> DataFrame:
    """``docs(id, doc)`` with ``r``, the rule, and ``unknown``, fields that a rule doesn't have (null: no JSON object)."""
    keys = F.json_object_keys("doc")
    return docs.withColumn("r", F.from_json("doc", RULE)).withColumn("unknown", F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS])))


def seconds(duration: Column) -> Column:
    """Seconds of a duration such as 5m, 36h or 30d; null for anything else."""
    n = F.regexp_extract(duration, "^([1-9][0-9]{0,5})[smhd]$", 1).try_cast("long")
    unit = F.create_map(*[F.lit(x) for p in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400)) for x in p])
    return n * unit[F.right(duration, F.lit(1))]


def _err(pointer: Column, detail: str) -> Column:
    return F.struct(pointer.alias("pointer"), F.lit(detail).alias("detail"))


def _if(bad: Column, pointer: str, detail: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), _err(F.lit(pointer), detail))


def _selector(s: Column, at: Column) -> Column:
    below = lambda f: F.concat(at, F.lit(f"/{f}"))
    one = F.array(
        F.when(F.size(s) == 0, _err(at, "empty_selector")), F.when(s["origin_key"].isNotNull() & s["origin_key_prefix"].isNotNull(), _err(below("origin_key_prefix"), "excludes_origin_key")),
        F.when(~s["entry"].isin("device", "manual"), _err(below("entry"), "not_an_entry")), F.when(~s["provider"].rlike("^[a-z][a-z0-9_]{0,63}$"), _err(below("provider"), "not_a_code")),
    )
    strange = F.array_except(F.map_keys(s), F.array(*[F.lit(f) for f in SELECTOR]))
    return F.concat(F.array_compact(one), F.transform(strange, lambda k: _err(F.concat(at, F.lit("/"), k), "unknown_field")))


def _n(i: Column) -> Column:
    return i.cast("string")


_SELECTORS = "array<map<string,string>>"


def _groups() -> Column:
    """Faults of the ladder: its length, then each group's name and selectors."""
    groups = F.coalesce("r.groups", F.array().cast(f"array<struct<id:string,match:{_SELECTORS}>>"))
    ids = F.transform(groups, lambda g: g["id"])

    def of(g: Column, i: Column) -> Column:
        at = F.concat(F.lit("/groups/"), _n(i))
        match = F.coalesce(g["match"], F.array().cast(_SELECTORS))
        name = F.when(~F.coalesce(g["id"], F.lit("")).rlike("^[a-z][a-z0-9_]{0,31}$"), "not_a_name").when(F.array_position(ids, g["id"]) <= i, "repeated_name")
        own = F.array(F.when(name.isNotNull(), F.struct(F.concat(at, F.lit("/id")).alias("pointer"), name.alias("detail"))), F.when(F.size(match) == 0, _err(F.concat(at, F.lit("/match")), "no_selector")))
        return F.concat(F.array_compact(own), F.flatten(F.transform(match, lambda s, j: _selector(s, F.concat(at, F.lit("/match/"), _n(j))))))

    return F.concat(F.array_compact(F.array(_if(~F.size(groups).between(1, 32), "/groups", "not_1_to_32"))), F.flatten(F.transform(groups, of)))


def _contexts() -> Column:
    """Faults of contexts: their names, and groups that the rule doesn't have."""
    ids = F.coalesce(F.transform("r.groups", lambda g: g["id"]), F.array().cast("array<string>"))

    def of(e: Column) -> Column:
        at = F.concat(F.lit("/contexts/"), e["key"])
        wrong = lambda g: F.when(g == "@workout_source", F.when(e["key"] != "workout", "workout_only")).when(~F.array_contains(ids, g), "unknown_group")
        each = F.transform(e["value"], lambda g, i: F.when(wrong(g).isNotNull(), F.struct(F.concat(at, F.lit("/"), _n(i)).alias("pointer"), wrong(g).alias("detail"))))
        return F.when(e["key"].isin("workout", "sleep"), F.array_compact(each)).otherwise(F.array(_err(at, "unknown_context")))

    return F.flatten(F.transform(F.map_entries(F.coalesce("r.contexts", F.create_map().cast("map<string,array<string>>"))), of))


def _allowed(agg: Column, kind: Column, derived: Column, reading: Column) -> Column:
    """Whether a metric may be resolved by a window kind."""
    own = F.lit(False)
    for a, kinds in ALLOWED.items():
        own = own | ((agg == a) & kind.isin(*kinds))
    return F.when(derived, kind.isin("local_night", "sleep_episode")).otherwise(own) | (reading & (kind == "reading"))


def _fields() -> list[Column]:
    """Faults that a field has by itself: not one of its values, or out of its range."""
    q, w, s = "r.quality.", "r.within_source.", "r.strategy."
    one = lambda field, values: F.col(field).isNotNull() & ~F.col(field).isin(*values)
    share = lambda field: F.col(field).isNotNull() & ~((F.col(field) > 0) & (F.col(field) <= 1))
    low, high = F.get(F.col(f"{q}plausible_range"), F.lit(0)), F.get(F.col(f"{q}plausible_range"), F.lit(1))
    return [
        _if(~F.col("r.schema").eqNullSafe(F.lit(VERSION)), "/schema", "other_version"), _if(~F.coalesce(F.col("r.window.kind").isin(*WINDOWS), F.lit(False)), "/window/kind", "not_a_window"), _if(~F.coalesce(F.col(f"{s}op").isin(*POOLS, *PICKS), F.lit(False)), "/strategy/op", "not_a_strategy"),
        _if(one(f"{s}on_insufficient", ("use_available", "no_value")), "/strategy/on_insufficient", "not_a_choice"), _if(one(f"{w}intra_group", ("auto", "mean", "max", "sum")), "/within_source/intra_group", "not_a_choice"),
        _if(one(f"{w}daily_value_policy", ("prefer_reported", "intervals_only")), "/within_source/daily_value_policy", "not_a_choice"), _if(one(f"{w}statistic", ("min_rolling_mean", "min", "latest", "mean")), "/within_source/statistic", "not_a_choice"),
        _if(share(f"{q}min_coverage"), "/quality/min_coverage", "not_a_share"), _if(share(f"{q}sleep.match_overlap"), "/quality/sleep/match_overlap", "not_a_share"), _if(~F.col(f"{q}sleep.night_anchor").rlike("^(1[2-9]|2[0-3]):[0-5][0-9]$"), "/quality/sleep/night_anchor", "not_an_evening"),
        _if(F.col(f"{q}max_staleness").isNotNull() & seconds(F.col(f"{q}max_staleness")).isNull(), "/quality/max_staleness", "not_a_duration"), _if(F.col(f"{q}plausible_range").isNotNull() & ((F.size(f"{q}plausible_range") != 2) | (low >= high)), "/quality/plausible_range", "not_a_range"),
        _if(F.col("r.compose").isNotNull() & ~F.col("r.compose.from").eqNullSafe(F.lit("hour")), "/compose/from", "hours_only"), _if(one("r.compose.op", ("first_available", "max")), "/compose/op", "not_a_choice"),
    ]


def _references() -> list[Column]:
    """Faults of names: metrics that aren't there, members of a family by themselves, leaders and wear that can't be asked."""
    fam, metric, follow, wear = F.col("_fam"), F.col("r.metric"), F.col("r.follow"), F.col("r.quality.require_wear")
    worn = F.coalesce((F.col("w.agg") == "intensive") & F.col("w.derived_from").isNull(), F.lit(False))
    return [
        _if(metric.isNull(), "/metric", "missing"), _if(metric.isNotNull() & F.col("m").isNull(), "/metric", "unknown_metric"), _if(~fam & ((F.col("m.agg") == "sleep_derived") | F.coalesce(F.col("m.reading") == "bp_reading", F.lit(False))), "/metric", "family_only"),
        _if(follow.isNotNull() & F.col("l").isNull(), "/follow", "unknown_metric"), _if(follow == metric, "/follow", "leads_itself"), _if((F.col("l.agg") == "sleep_derived") | (F.col("l.reading") == "bp_reading"), "/follow", "family_leader"), _if(follow.isNotNull() & fam, "/follow", "family_follows"),
        _if(wear.isNotNull() & ~worn, "/quality/require_wear", "not_worn"),
    ]


def _together() -> list[Column]:
    """Faults of fields that don't go together, or not with the metric's class."""
    c = F.col
    kind, op, agg, stat, size = c("r.window.kind"), c("r.strategy.op"), c("m.agg"), c("r.within_source.statistic"), c("r.window.size")
    known, fam, derived = c("m").isNotNull(), c("_fam"), c("m.derived_from").isNotNull()
    q, ws, least = (lambda f: c(f"r.quality.{f}")), (lambda f: c(f"r.within_source.{f}")), c("r.strategy.min_sources")
    pooling, bucketed = op.isin(*POOLS), agg.isin(*BUCKETED) | derived
    acked = F.coalesce(F.array_contains("r.acknowledged_warnings", "cross_source_sum"), F.lit(False))
    poolable = ~c("m.provider_scoped") & ~c("m.selection_only")
    may = op.isin("single_source", "first_available", "latest", "earliest") | (poolable & op.isin(*POOLS[:3])) | ((agg == "additive") & (op == POOLS[3])) | ((agg == "sleep_derived") & (op == "event_priority"))
    nightly, span = kind.isin("local_day", "local_night", "sleep_episode"), seconds(ws("span"))
    rolling = stat.eqNullSafe(F.lit("min_rolling_mean"))
    return [
        _if(known & kind.isin(*WINDOWS) & ~_allowed(agg, kind, derived, c("m.reading").isNotNull()), "/window/kind", "not_of_class"), _if(known & op.isin(*POOLS, *PICKS) & ~may, "/strategy/op", "not_of_class"), _if(fam & c("m.reading").isNotNull() & pooling, "/strategy/op", "parts_stay_together"),
        _if(F.when(kind == "bucket", ~F.coalesce(size.isin(*SIZES), F.lit(False))).otherwise(size.isNotNull()), "/window/size", "buckets_only"), _if((op == "single_source") & (F.size("r.groups") > 1), "/groups", "one_group_only"),
        _if(least.isNotNull() & ~F.coalesce(pooling & least.between(1, F.size("r.groups")), F.lit(False)), "/strategy/min_sources", "not_in_pool"), _if(c("r.strategy.on_insufficient").isNotNull() & ~F.coalesce(pooling, F.lit(False)), "/strategy/on_insufficient", "pools_only"),
        _if(((op == POOLS[3]) | F.coalesce(ws("intra_group") == "sum", F.lit(False))) & ~acked, "/acknowledged_warnings", "sum_not_acknowledged"), _if((op == POOLS[3]).isNull() & (ws("intra_group") == "sum") & ~acked, "/acknowledged_warnings", "sum_not_acknowledged"),
        _if(derived & ~F.coalesce(stat.isin("min_rolling_mean", "min"), F.lit(False)), "/within_source/statistic", "lowest_only"), _if(stat.isin("min_rolling_mean", "min") & (agg != "intensive"), "/within_source/statistic", "not_of_class"), _if(stat.isin("latest", "mean") & ((agg != "latest") | (kind != "local_day")), "/within_source/statistic", "not_of_class"),
        _if(rolling & ~nightly, "/within_source/statistic", "not_of_window"), _if((stat == "min") & ~(nightly | (kind == "hour")), "/within_source/statistic", "not_of_window"), _if(F.when(rolling, span.isNull() | (span % 300 != 0) | (span > 43200)).otherwise(ws("span").isNotNull()), "/within_source/span", "not_of_statistic"),
        _if(ws("intra_group").isin("mean", "max", "sum") & ~bucketed, "/within_source/intra_group", "not_of_class"), _if((ws("intra_group") == "sum") & (agg != "additive"), "/within_source/intra_group", "not_of_class"), _if(ws("daily_value_policy").isNotNull() & (agg != "additive"), "/within_source/daily_value_policy", "not_of_class"),
        _if(q("min_coverage").isNotNull() & ~bucketed, "/quality/min_coverage", "not_of_class"), _if(q("require_wear").isNotNull() & ~bucketed, "/quality/require_wear", "not_of_class"), _if(q("plausible_range").isNotNull() & fam, "/quality/plausible_range", "family_has_none"),
        _if(c("r.compose").isNotNull() & ((agg != "additive") | (kind != "local_day") | c("r.follow").isNotNull()), "/compose", "not_of_class"),
    ]


def checked(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``docs(id, doc)`` with ``metric``, ``follow``, ``window`` and ``errors array<struct<pointer,detail>>``, empty for a rule that may be used.

    ``catalogue(code, agg, reading, provider_scoped, selection_only, derived_from)`` describes the metrics.
    A family of metrics counts as its representative.  ``detail`` is a code: what is wrong at the pointer.
    """
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    df = parsed(docs.drop("metric", "follow", "window")).withColumn("_code", F.coalesce(family[F.col("r.metric")], F.col("r.metric"))).withColumn("_fam", family[F.col("r.metric")].isNotNull())
    part = lambda code, name, *fields: catalogue.select(F.col("code").alias(code), F.struct(*fields).alias(name))
    df = df.join(part("_code", "m", "agg", "reading", "provider_scoped", "selection_only", "derived_from"), "_code", "left")
    df = df.join(part("_lead", "l", "agg", "reading"), F.col("r.follow") == F.col("_lead"), "left").join(part("_worn", "w", "agg", "derived_from"), F.col("r.quality.require_wear") == F.col("_worn"), "left")
    listed = lambda c, names, pointer: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.when(~x.isin(*names) | (F.array_position(c, x) <= i), _err(F.concat(F.lit(pointer), _n(i)), "unknown_or_repeated"))))
    errors = F.concat(
        F.transform("unknown", lambda k: _err(F.concat(F.lit("/"), k), "unknown_field")), F.array_compact(F.array(*_fields(), *_references(), *_together())), _groups(), _contexts(),
        F.flatten(F.transform(F.coalesce("r.exclude", F.array().cast(_SELECTORS)), lambda s, i: _selector(s, F.concat(F.lit("/exclude/"), _n(i))))),
        listed(F.col("r.quality.exclude_flags"), FLAGS, "/quality/exclude_flags/"), listed(F.col("r.acknowledged_warnings"), WARNINGS, "/acknowledged_warnings/"),
    )
    errors = F.when(F.col("unknown").isNull() | F.col("r").isNull(), F.array(_err(F.lit(""), "not_an_object"))).otherwise(errors)
    kept = [c for c in docs.columns if c not in ("metric", "follow", "window")]
    return df.select(*kept, F.col("r.metric").alias("metric"), F.col("r.follow").alias("follow"), F.col("r.window").alias("window"), errors.alias("errors"))


def leaders(rules: DataFrame, name: str = "leaders") -> DataFrame:
    """``(metric, leader, steps)``: every rule that another follows, directly or through others; a rule in a cycle leads itself.

    Chains double in every round, so that a chain of any length takes few of them.
    """
    scratch = Scratch(rules.sparkSession, name)
    reach = scratch.save(rules.where("follow is not null").select("metric", F.col("follow").alias("leader"), F.lit(1).cast("long").alias("steps")))
    while True:
        hop = reach.select(F.col("metric").alias("leader"), F.col("leader").alias("_next"), F.col("steps").alias("_more"))
        new = reach.join(hop, "leader").where("metric <> leader").select("metric", F.col("_next").alias("leader"), (F.col("steps") + F.col("_more")).alias("steps"))
        grown = scratch.save(reach.union(new).groupBy("metric", "leader").agg(F.min("steps").alias("steps")))
        if grown.count() == reach.count():
            return reach
        reach = grown


def checked_set(rules: DataFrame) -> DataFrame:
    """``(id, problem)`` of rules that can't be active together: a metric twice, another window than the leader's, a cycle of followers."""
    twice = rules.withColumn("_n", F.row_number().over(Window.partitionBy("metric").orderBy("id"))).where("_n > 1").select("id", F.lit("duplicate_metric").alias("problem"))
    lead = rules.select(F.col("metric").alias("follow"), F.col("window").alias("_w"))
    other = rules.join(lead, "follow").where(~F.col("window").eqNullSafe(F.col("_w"))).select("id", F.lit("other_window").alias("problem"))
    cycle = leaders(rules).where("metric = leader").select("metric")
    return twice.union(other).union(rules.join(cycle, "metric").select("id", F.lit("follow_cycle").alias("problem"))).distinct()


def activation_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Problems that a set of rules has and the one before it hadn't: what an activation would introduce."""
    return checked_set(after).join(checked_set(before), ["id", "problem"], "left_anti")


def defaults(catalogue: DataFrame, ruled: DataFrame, order: list[str]) -> DataFrame:
    """``(metric, window, groups)`` for metrics without a rule: the provider of a score that only it gives, else the owner's providers in order, then any device, then entries by hand."""
    own = F.array(*[F.lit(g) for g in dict.fromkeys([*order, "device", "manual"])])
    groups = F.when(F.col("provider_scoped"), F.array(F.split_part("code", F.lit("_"), F.lit(1)))).otherwise(own)
    day = F.lit(False)
    for a, kinds in ALLOWED.items():
        day = day | ((F.col("agg") == a) & F.lit("local_day" in kinds))
    day = day & F.col("derived_from").isNull()
    left = catalogue.join(ruled.select(F.col("metric").alias("code")), "code", "left_anti")
    return left.select(F.col("code").alias("metric"), F.when(day, "local_day").otherwise("local_night").alias("window"), groups.alias("groups"))
