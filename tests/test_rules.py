"""Documents with one fault each, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import compiler, rules
from strandline.sources import catalogue


def doc(**more):
    return {"schema": rules.VERSION, "metric": "pulse", "window": {"kind": "local_day"}, "groups": [{"id": "a", "match": [{"provider": "p"}]}, {"id": "b", "match": [{"entry": "manual"}]}], "strategy": {"op": "first_available"}} | more


FAULTS = (
    (doc(), ""), (doc(schema="v9"), "/schema"), (doc(metric="nothing"), "/metric"), (doc(metric="sleep_deep", window={"kind": "local_night"}), "/metric"), (doc(metric="bp_diastolic", window={"kind": "latest"}), "/metric"), (doc(extra=1), "/extra"),
    (doc(groups=[]), "/groups"), (doc(groups=[{"id": "A!", "match": [{"provider": "p"}]}]), "/groups/0/id"), (doc(groups=[{"id": "a", "match": [{"provider": "p"}]}, {"id": "a", "match": [{"provider": "q"}]}]), "/groups/1/id"),
    (doc(groups=[{"id": "a", "match": []}]), "/groups/0/match"), (doc(groups=[{"id": "a", "match": [{}]}]), "/groups/0/match/0"), (doc(groups=[{"id": "a", "match": [{"colour": "red"}]}]), "/groups/0/match/0/colour"),
    (doc(exclude=[{"entry": "robot"}]), "/exclude/0/entry"), (doc(window={"kind": "week"}), "/window/kind"), (doc(metric="level", window={"kind": "hour"}), "/window/kind"), (doc(window={"kind": "bucket", "size": "7m"}), "/window/size"), (doc(window={"kind": "hour", "size": "5m"}), "/window/size"),
    (doc(strategy={"op": "best"}), "/strategy/op"), (doc(metric="total", strategy={"op": "mean_across_sources"}), "/strategy/op"), (doc(strategy={"op": "sum_across_sources"}, acknowledged_warnings=["cross_source_sum"]), "/strategy/op"), (doc(strategy={"op": "event_priority"}), "/strategy/op"),
    (doc(strategy={"op": "single_source"}), "/groups"), (doc(strategy={"op": "first_available", "min_sources": 2}), "/strategy/min_sources"), (doc(strategy={"op": "mean_across_sources", "min_sources": 3}), "/strategy/min_sources"), (doc(strategy={"op": "mean_across_sources", "on_insufficient": "guess"}), "/strategy/on_insufficient"),
    (doc(metric="clicks", strategy={"op": "sum_across_sources"}), "/acknowledged_warnings"), (doc(metric="clicks", strategy={"op": "sum_across_sources"}, acknowledged_warnings=["cross_source_sum"]), ""), (doc(acknowledged_warnings=["hm"]), "/acknowledged_warnings/0"),
    (doc(metric="pulse_low", window={"kind": "local_night"}), "/within_source/statistic"), (doc(within_source={"intra_group": "median"}), "/within_source/intra_group"), (doc(metric="level", within_source={"intra_group": "max"}), "/within_source/intra_group"),
    (doc(within_source={"daily_value_policy": "prefer_reported"}), "/within_source/daily_value_policy"), (doc(within_source={"statistic": "min_rolling_mean", "span": "7m"}), "/within_source/span"), (doc(within_source={"statistic": "min_rolling_mean", "span": "30m"}), ""), (doc(within_source={"statistic": "min", "span": "5m"}), "/within_source/span"),
    (doc(within_source={"statistic": "mean"}), "/within_source/statistic"), (doc(quality={"min_coverage": 1.5}), "/quality/min_coverage"), (doc(quality={"plausible_range": [9, 3]}), "/quality/plausible_range"), (doc(quality={"exclude_flags": ["relayed", "relayed"]}), "/quality/exclude_flags/1"),
    (doc(quality={"max_staleness": "0d"}), "/quality/max_staleness"), (doc(quality={"require_wear": "clicks"}), "/quality/require_wear"), (doc(quality={"sleep": {"night_anchor": "11:00"}}), "/quality/sleep/night_anchor"), (doc(contexts={"rain": ["a"]}), "/contexts/rain"), (doc(contexts={"sleep": ["z"]}), "/contexts/sleep/0"),
    (doc(contexts={"sleep": ["@workout_source"]}), "/contexts/sleep/0"), (doc(follow="pulse"), "/follow"), (doc(follow="nobody"), "/follow"), (doc(follow="bp_diastolic"), "/follow"), (doc(compose={"from": "hour", "op": "max"}), "/compose"), (doc(metric="clicks", compose={"from": "day", "op": "max"}), "/compose/from"),
)


def test_each_fault_is_found_where_it_is(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(FAULTS)] + [(len(FAULTS), "{not a rule"), (len(FAULTS) + 1, None)], "id int, doc string")
    got = {r.id: sorted({e.pointer for e in r.errors}) for r in rules.checked(docs, catalogue.metrics(spark)).collect()}
    assert got == {i: [p] if p else [] for i, (_, p) in enumerate(FAULTS)} | {len(FAULTS): [""], len(FAULTS) + 1: [""]}
