"""Any set of rule documents as one plan: what a rule says is data in columns, and every row is joined to its rule.

There is no plan for each rule.  A document becomes one row of the *dispatch* table (class, window kind,
statistic, strategy, gates and so on as columns) and one row for each selector in the *predicate* table
(its eleven fields as columns, null where it doesn't ask).  Sources meet predicates once, rows meet their
rule by owner and metric, and each further step is a conditional expression over the dispatch columns.
Rows shrink to buckets of five minutes before anything is sorted, and an owner's rules and sources are
small beside the owner's rows, so that the joins are of many rows with few.

Tables that go in, besides ``rules(rule, owner, metric, doc)``; instants are microseconds:

- ``rows(owner, metric, id, source_id, kind, lo, hi, zone, local_date, value, flags array<string>, reading)``, ``kind`` being
  sample, interval or daily_value;
- ``sources(source_id, <the eleven fields of a selector>)``, ``relayed`` and ``entry`` as text;
- ``nights(owner, night, lo, hi, main)``: aligned episodes, for windows of the night; optional;
- ``events(owner, context, lo, hi, source_id)``: workouts and episodes, for contexts; optional.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import settled, window_key
from strandline.operators import rules as documents
from strandline.operators.joins import overlap, points_in_spans
from strandline.operators.strategy import group_status
from strandline.sources.scratch import Scratch

BASE = 300_000_000
DAY = 86_400_000_000
#: How far back a latest value may be from, in days.
LOOKBACK = 366
FIELDS = ("provider", "connection_id", "origin_key", "origin_name", "relayed", "device_type", "device_model", "device_manufacturer", "device_id", "entry")
EXCLUDED = -1
WINDOW = ["rule", "window_key"]
WALL, NIGHT = ("bucket", "hour"), ("local_night", "sleep_episode")


def dispatch(rules: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row for each rule: what decides how it is resolved, as plain columns.

    ``catalogue(code, agg, derived_from)``; a metric derived from another reads that one's rows (``reads``).
    """
    family = F.create_map(*[F.lit(x) for kv in documents.FAMILIES.items() for x in kv])
    m = catalogue.select(F.col("code").alias("_code"), "agg", "derived_from")
    r = documents.parsed(rules.select("rule", "owner", "metric", "doc")).withColumn("_code", F.coalesce(family[F.col("metric")], F.col("metric"))).join(m, "_code", "left")
    kind, q, w = F.col("r.window.kind"), "r.quality.", "r.within_source."
    minutes = documents.seconds(F.col("r.window.size"))
    composed = F.col("r.compose").isNotNull()
    return r.select(
        "rule", "owner", "metric", F.coalesce("derived_from", "metric").alias("reads"), F.coalesce("agg", F.lit("latest")).alias("agg"),
        F.when(composed, "hour").otherwise(kind).alias("window"), F.when(composed, F.lit("1h")).otherwise(F.col("r.window.size")).alias("_size"),
        F.when(composed | (kind == "hour"), F.lit(3600)).otherwise(minutes).cast("long").alias("seconds"), F.col("r.strategy.op").alias("op"), F.coalesce("r.strategy.min_sources", F.lit(1)).alias("least"),
        F.coalesce(F.col("r.strategy.on_insufficient") != "no_value", F.lit(True)).alias("use_available"), F.coalesce(F.nullif(F.col(f"{w}intra_group"), F.lit("auto")), F.when(F.col("agg") == "additive", "max").otherwise("mean")).alias("intra"),
        F.col(f"{w}statistic").alias("statistic"), (documents.seconds(F.col(f"{w}span")) / 300).cast("int").alias("span"), F.coalesce(F.col(f"{w}daily_value_policy") != "intervals_only", F.lit(True)).alias("reported"),
        F.get(F.col(f"{q}plausible_range"), F.lit(0)).alias("low"), F.get(F.col(f"{q}plausible_range"), F.lit(1)).alias("high"), F.coalesce(F.col(f"{q}exclude_flags"), F.array().cast("array<string>")).alias("barred"),
        F.col(f"{q}min_coverage").alias("min_coverage"), (documents.seconds(F.col(f"{q}max_staleness")) * 1_000_000).alias("staleness"), F.col("r.follow").alias("follow"), F.col("r.compose.op").alias("compose"),
        F.coalesce("r.contexts", F.create_map().cast("map<string,array<string>>")).alias("contexts"), F.size("r.groups").alias("n_groups"),
    ).drop("_size")


def predicates(rules: DataFrame) -> DataFrame:
    """``(rule, pos, group, <fields>, origin_key_prefix)``: a row for each selector; those of ``exclude`` have the position ``EXCLUDED``."""
    r = documents.parsed(rules.select("rule", "doc"))
    kept = r.select("rule", F.posexplode("r.groups").alias("pos", "g")).select("rule", "pos", F.col("g.id").alias("group"), F.explode("g.match").alias("s"))
    out = r.select("rule", F.explode("r.exclude").alias("s")).select("rule", F.lit(EXCLUDED).alias("pos"), F.lit(None).cast("string").alias("group"), "s")
    return kept.unionByName(out).select("rule", "pos", "group", *[F.col("s")[f].alias(f) for f in (*FIELDS, "origin_key_prefix")])


def agrees(p: str, s: str) -> Column:
    """Whether a selector ``p`` agrees with a source ``s``: every field that it sets, a set one never with a null."""
    parts = []
    for f in FIELDS:
        want, have = F.col(f"{p}.{f}"), F.col(f"{s}.{f}")
        same = F.lower(want) == F.lower(have) if f == "device_manufacturer" else want == have
        parts.append(want.isNull() | F.coalesce(same, F.lit(False)))
    prefix = F.col(f"{p}.origin_key_prefix")
    parts.append(prefix.isNull() | F.coalesce(F.startswith(F.col(f"{s}.origin_key"), prefix), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def memberships(sources: DataFrame, used: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(rule, source_id, pos, group)`` of ``used(rule, source_id)``: the first group that a source agrees with, ``EXCLUDED`` before all; null: none."""
    p, s = chosen.select("rule", "pos", "group", F.struct(*FIELDS, "origin_key_prefix").alias("p")), sources.select("source_id", F.struct(*FIELDS).alias("s"))
    met = used.join(s, "source_id").join(p, "rule").where(agrees("p", "s"))
    first = met.groupBy("rule", "source_id").agg(F.min(F.struct("pos", "group")).alias("r")).select("rule", "source_id", "r.*")
    return used.join(first, ["rule", "source_id"], "left")


def _windowed(rows: DataFrame) -> DataFrame:
    """Rows of the wall clock's windows, of days, of readings and of latest values, once for each window that they reach."""
    date = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_micros(c), F.col("zone")))
    midnight = lambda d: F.unix_micros(F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), F.col("zone")))
    wall = F.col("window").isin(*WALL)
    end = F.greatest(F.col("hi") - 1, F.col("lo"))
    days = F.when(wall, F.sequence(date(F.col("lo")), date(end))).when(F.col("window") == "local_day", F.array("local_date")).otherwise(F.array(date(F.col("lo"))))
    r = rows.withColumn("date", F.explode(days)).withColumn("_d0", midnight(F.col("date"))).withColumn("_d1", midnight(F.date_add("date", 1)))
    size = F.col("seconds") * 1_000_000
    from_, to = F.greatest("lo", "_d0"), F.greatest(F.least("hi", "_d1"), F.greatest("lo", "_d0"))
    r = r.withColumn("_size", size).withColumn("_from", from_).withColumn("_to", to)
    slots = F.when(wall, F.sequence(F.expr("(_from - _d0) div _size"), F.expr("(greatest(_to - 1, _from) - _d0) div _size"))).otherwise(F.array(F.lit(0).cast("long")))
    r = r.withColumn("_slot", F.explode(slots))
    start = F.when(wall, F.col("_d0") + F.col("_slot") * F.col("_size")).otherwise(F.col("_d0"))
    stop = F.when(wall, F.least(F.col("_d0") + (F.col("_slot") + 1) * F.col("_size"), F.col("_d1"))).otherwise(F.col("_d1"))
    r = r.withColumn("start", start).withColumn("end", stop)
    reading = F.when(F.col("reading").isNotNull(), F.concat(F.lit("g:"), F.col("reading").cast("string"))).otherwise(F.concat(F.lit("m:"), F.col("id").cast("string")))
    key = F.when(wall, window_key(F.timestamp_micros("start"))).when(F.col("window") == "reading", reading).otherwise(F.col("date").cast("string"))
    return r.withColumn("window_key", key).drop("_d0", "_d1", "_from", "_to", "_size", "_slot")


def _nightly(rows: DataFrame, nights: DataFrame) -> DataFrame:
    """Rows of the night's windows: in the main episode of a night, or in any episode; samples by their instant, intervals by overlap."""
    spans = nights.select("owner", F.col("night").alias("date"), F.col("lo").alias("start"), F.col("hi").alias("end"), "main")
    point = F.col("hi") <= F.col("lo")
    held = points_in_spans(rows.where(point), spans, ["owner"], "lo", ("start", "end")).unionByName(overlap(rows.where(~point), spans, ["owner"], ("lo", "hi"), ("start", "end")))
    held = held.where(F.col("main") | (F.col("window") == "sleep_episode")).drop("main")
    return held.withColumn("window_key", F.when(F.col("window") == "local_night", F.col("date").cast("string")).otherwise(window_key(F.timestamp_micros("start"))))


def _gated(rows: DataFrame) -> DataFrame:
    """Rows with ``gone``: barred by a flag, or out of the plausible range where it is one of rows (sums have one of their own)."""
    out = F.when(F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), "barred"), "flagged")
    ranged = (F.col("agg") != "additive") & (F.col("high") > F.col("low"))
    return rows.withColumn("gone", out.when(ranged & ~F.col("value").between(F.col("low"), F.col("high")), "implausible"))


#: What a window's values carry of their rule.
_RULE = ["owner", "metric", "window", "agg", "intra", "statistic", "span", "reported", "low", "high", "min_coverage", "staleness"]


def group_values(placed: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each window and group with rows: ``value``, ``covered``, ``at``, ``first``, ``n``, and the rows that gates took.

    Three aggregations: a source's rows in a bucket, the sources of a group in a bucket, the buckets of a
    window.  Each keeps what any class or statistic may need, and the last one picks.  One shuffle by the
    window, before intervals are cut into buckets, serves all three; ``rules`` (of ``dispatch``) come last.
    Rules that need sums and means alone keep nothing but numbers, so that their buckets are hashed and not
    sorted; where it is their sum that counts, an interval alone in its window and group isn't cut at all.
    """
    additive, window = F.col("agg") == "additive", F.col("window")
    summed = (additive & (~window.isin("local_day", "latest", "reading") | ~F.col("reported"))) | ((F.col("agg") == "intensive") & (window != "latest"))
    plain = F.coalesce(summed & (F.coalesce("statistic", F.lit("")) != "min_rolling_mean"), F.lit(False))
    total = plain & additive & F.col("statistic").isNull()
    v = _aggregated(placed.where(total), lone=True).unionByName(_aggregated(placed.where(plain & ~total))).unionByName(_aggregated(placed.where(~plain), whole=True))
    v = v.join(rules.select("rule", *_RULE), "rule")
    v = v.withColumns({c: settled(F.col(c)) for c in ("_avg", "_sum", "_mean")})
    return v.withColumn("value", _picked()).drop("_avg", "_sum", "_min", "_daily", "_mean", "_last", "_dlast", "_series")


def _aggregated(placed: DataFrame, whole: bool = False, lone: bool = False) -> DataFrame:
    """Sums, means and counts of each window and group; if ``whole``, its last rows and its series of buckets as well.

    If ``lone``, an interval that shares its window and group with no row stands for all its buckets (``_cells``) in one row: ``_sum``, ``covered``
    and the counts are those of its buckets, ``_avg``, ``_min`` and ``_mean`` are not.
    """
    ok, daily = F.col("gone").isNull(), F.col("kind") == "daily_value"
    additive = F.col("agg") == "additive"
    lo, hi = F.greatest("lo", "start"), F.least("hi", "end")
    clip = F.col("window").isin(*WALL, *NIGHT)
    a, b = F.when(clip, lo).otherwise(F.col("lo")), F.when(clip, hi).otherwise(F.col("hi"))
    spread = additive & ~daily & (F.col("hi") > F.col("lo"))
    put = F.when(F.col("intra") == "sum", 1).when(F.col("intra") == "max", 2).otherwise(0)
    rolled = F.coalesce(F.col("statistic") == "min_rolling_mean", F.lit(False))
    r = placed.select(*WINDOW, "pos", "group", "source_id", "id", "kind", "lo", "hi", "value", "gone", "start", "end", "date", "window", "agg", additive.alias("_additive"), put.alias("_put"), rolled.alias("_rolled")).repartition(*WINDOW).withColumn("_a", a).withColumn("_b", b)
    keys = [*WINDOW, "pos", "group"]
    alone = spread & (F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1) if lone else F.lit(False)
    low, high = F.expr(f"_a div {BASE}"), F.expr(f"(greatest(_b - 1, _a)) div {BASE}")
    r = r.withColumn("_alone", alone).withColumn("_cells", F.when(F.col("_alone"), high - low + 1).otherwise(F.lit(1).cast("long")))
    cells = F.when(daily, F.array(F.lit(-1).cast("long"))).when(F.col("_alone"), F.array(low)).when(spread, F.sequence(low, high)).otherwise(F.array(F.expr(f"lo div {BASE}")))
    r = r.withColumn("b", F.explode(cells))
    share = F.when(F.col("_alone"), F.col("_b") - F.col("_a")).otherwise(F.least(F.col("_b"), (F.col("b") + 1) * BASE) - F.greatest(F.col("_a"), F.col("b") * BASE))
    r = r.withColumn("x", F.when(spread, F.col("value") * share / (F.col("hi") - F.col("lo"))).otherwise(F.col("value")))
    fixed = ("_rolled", "_cells", "start", "end", "date")
    count = lambda c: F.sum(F.when(c, F.col("_cells")).otherwise(0))
    last = F.when(ok, F.struct("lo", "id", "value"))
    each = r.groupBy(*keys, "source_id", "b").agg(
        *[F.first(c).alias(c) for c in ("_additive", "_put", *fixed)], F.avg(F.when(ok, F.col("x"))).alias("mean"), F.sum(F.when(ok, F.col("x"))).alias("total"), F.max(F.when(ok, F.col("lo"))).alias("at"),
        F.min(F.when(ok, F.col("lo"))).alias("first"), count(ok).alias("n"), count(F.col("gone") == "flagged").alias("flagged"), count(F.col("gone") == "implausible").alias("implausible"),
        *([F.max_by("value", last).alias("newest"), F.max(last).alias("last")] if whole else []),
    )
    of = F.when(F.col("_additive"), F.col("total")).otherwise(F.col("mean"))
    each = each.withColumn("m", F.when(F.col("b") == -1, F.col("newest")).otherwise(of) if whole else of)
    sums = [F.sum(c).alias(c) for c in ("n", "flagged", "implausible")]
    joined = F.when(F.first("_put") == 1, F.sum("m")).when(F.first("_put") == 2, F.max("m")).otherwise(F.avg("m"))
    bucket = each.groupBy(*keys, "b").agg(
        *[F.first(c).alias(c) for c in fixed], joined.alias("m"), F.sum(F.col("mean") * F.col("n")).alias("weighted"), F.max("at").alias("at"), F.min("first").alias("first"), *sums,
        *([F.max("last").alias("last")] if whole else []),
    )
    walked, day = F.when(F.col("b") >= 0, F.col("m")), F.col("b") == -1
    out = bucket.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("start", "end", "date")], F.avg(walked).alias("_avg"), F.sum(walked).alias("_sum"), F.min(walked).alias("_min"), F.max(F.when(day, F.col("m"))).alias("_daily"), count(walked.isNotNull()).alias("covered"),
        (F.sum("weighted") / F.sum("n")).alias("_mean"), F.max("at").alias("at"), F.min("first").alias("first"), *sums,
        *([F.max("last").alias("_last"), F.max(F.when(day, F.col("last"))).alias("_dlast"), _series().alias("_series")] if whole else []),
    )
    none = F.lit(None)
    return out if whole else out.withColumns({"_last": none.cast(_LAST), "_dlast": none.cast(_LAST), "_series": none.cast("array<struct<b:bigint,m:double>>")})


_LAST = "struct<lo:bigint,id:bigint,value:double>"


def _series() -> Column:
    return F.when(F.first("_rolled"), F.array_sort(F.collect_list(F.when((F.col("b") >= 0) & F.col("m").isNotNull() & F.col("_rolled"), F.struct("b", "m")))))


def _rolling() -> Column:
    """The lowest mean over ``span`` buckets in a row: a running list of at most that many, over the buckets of one window."""
    start = F.struct(F.array().cast("array<struct<b:bigint,m:double>>").alias("held"), F.lit(None).cast("double").alias("low"))

    def step(a: Column, x: Column) -> Column:
        held = F.filter(F.concat(a["held"], F.array(F.struct(x["b"].alias("b"), x["m"].alias("m")))), lambda y: y["b"] > x["b"] - F.col("span"))
        mean = F.aggregate(held, F.lit(0.0), lambda s, y: s + y["m"]) / F.col("span")
        low = F.when((F.size(held) == F.col("span")) & (a["low"].isNull() | (mean < a["low"] - 1e-9)), mean).otherwise(a["low"])
        return F.struct(held.alias("held"), low.alias("low"))

    return F.aggregate("_series", start, step, lambda a: a["low"])


def _picked() -> Column:
    stat, agg = F.col("statistic"), F.col("agg")
    return (
        F.when(stat == "min_rolling_mean", _rolling()).when(stat == "min", F.col("_min")).when(stat == "mean", F.col("_mean"))
        .when((F.col("window") == "latest") & (agg != "daily_summary"), F.col("_last.value"))
        .when(agg == "additive", F.when(F.col("reported"), F.coalesce("_daily", "_sum")).otherwise(F.col("_sum")))
        .when(agg == "intensive", F.col("_avg")).when(agg == "daily_summary", F.coalesce(F.col("_dlast.value"), F.col("_last.value"))).otherwise(F.col("_last.value"))
    )


def _carried(values: DataFrame, days: DataFrame, now: Column) -> DataFrame:
    """Values of latest windows on every date of ``days(owner, date, start, end)``: the last one of each group so far, ``LOOKBACK`` days at most."""
    state = [c for c in values.columns if c not in ("rule", "pos", "group", "owner", "date", "window_key", "start", "end")]
    groups = values.select("rule", "owner", "pos", "group").distinct().join(days, "owner")
    own = values.where(F.col("at") <= now).select("rule", "pos", "date", F.struct(*state).alias("_s"))
    number = F.datediff("date", F.lit("1970-01-01"))
    w = Window.partitionBy("rule", "pos").orderBy(number).rangeBetween(-LOOKBACK, 0)
    held = groups.join(own, ["rule", "pos", "date"], "left").withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return held.where("_s is not null").select("rule", "pos", "group", "owner", "date", F.col("date").cast("string").alias("window_key"), "start", "end", "_s.*").select(values.columns)


def _gate(now: Column) -> Column:
    """Why a group doesn't take part (null: it does): nothing there, or by which gate of rows; a sum out of range; too little covered; too old."""
    seen = F.coalesce("n", F.lit(0)) > 0
    none = F.when(~seen & (F.col("implausible") > 0), "implausible").when(~seen & (F.col("flagged") > 0), "flagged").when(~seen | F.col("value").isNull(), "no_data")
    ranged = (F.col("agg") == "additive") & (F.col("high") > F.col("low"))
    bucketed = (F.col("agg") == "intensive") & (F.col("window") != "latest")
    return (
        none.when(ranged & ~F.col("value").between(F.col("low"), F.col("high")), "implausible").when(bucketed & (F.col("coverage") < F.col("min_coverage")), "below_coverage")
        .when(F.least(F.col("end"), now) - F.col("at") > F.col("staleness"), "stale")
    )


def _contexts(windows: DataFrame, events: DataFrame | None, member: DataFrame) -> DataFrame:
    """``windows`` with ``context`` and ``recorder``, the group that recorded the workout: an event covers half of the window or more, workouts first."""
    night = F.col("window").isin(*NIGHT)
    out = windows.withColumn("_night", F.when(night, "sleep"))
    if events is None:
        return out.withColumn("context", F.col("_night")).withColumn("recorder", F.lit(None).cast("string")).drop("_night")
    asked = windows.where(~night & F.col("window").isin(*WALL, "local_day")).select(*WINDOW, "owner", "start", "end")
    met = overlap(asked, events.select("owner", "context", "source_id", F.col("lo").alias("e_lo"), F.col("hi").alias("e_hi")), ["owner"], ("start", "end"), ("e_lo", "e_hi"))
    met = met.where(2 * (F.least("end", "e_hi") - F.greatest("start", "e_lo")) >= F.col("end") - F.col("start")).join(member.where("pos >= 0").select("rule", "source_id", F.col("group").alias("recorder")), ["rule", "source_id"], "left")
    best = met.groupBy(*WINDOW).agg(F.min_by(F.struct("context", "recorder"), F.struct(F.col("context") != "workout", "e_lo", "e_hi", "source_id")).alias("c"))
    return out.join(best, WINDOW, "left").withColumn("context", F.coalesce("_night", "c.context")).withColumn("recorder", F.when(F.col("context") == "workout", F.col("c.recorder"))).drop("_night", "c")


#: What is kept of a group with rows, in its window's array.
_OWN = ("pos", "group", "value", "n", "at", "first", "coverage", "reason")


def _judged(values: DataFrame, now: Column) -> DataFrame:
    """``values`` with ``coverage`` and ``reason``."""
    span = F.least(F.col("end"), now) - F.col("start")
    v = values.withColumn("coverage", F.when(span > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.ceil(span / BASE))).otherwise(0.0))
    return v.withColumn("reason", _gate(now))


def _listed() -> Column:
    """Groups that the window's context puts first; null where there are none."""
    return F.transform(F.col("contexts")[F.col("context")], lambda g: F.when(g == "@workout_source", F.col("recorder")).otherwise(g))


def _ladder(pos: Column, group: Column) -> Column:
    """Place of a group in its window: those that the context lists in that order, then the rule's own order."""
    place = F.array_position("_listed", group)
    return F.when(place > 0, place.cast("int")).otherwise(pos + 1000)


class Resolution:
    """``groups``: every group of every window with its value, status and place; ``results``: one row for each window."""

    def __init__(self, groups: DataFrame, results: DataFrame) -> None:
        self.groups, self.results = groups, results


def _chosen(windows: DataFrame) -> DataFrame:
    """Each window by the strategy of its rule: ``_own`` are its groups with rows, ``_names`` all groups of the rule, both as few as the document lists."""
    rank = lambda x: _ladder(x["pos"], x["group"])
    ok = F.transform(F.filter("_own", lambda x: x["reason"].isNull()), lambda x: F.struct(*[x[c].alias(c) for c in ("value", "group", "at", "first")], rank(x).alias("ladder")))
    top = F.when(F.col("_listed").isNull(), F.get("_names", F.lit(0))["pos"] + 1000).otherwise(F.array_min(F.transform("_names", rank)))
    one = windows.withColumn("_ok", ok).withColumn("valid", F.size("_ok").cast("long")).withColumn("_top", top)
    pool = F.col("op").isin(*documents.POOLS)
    few = pool & (F.col("valid") > 0) & (F.col("valid") < F.col("least"))
    there = (F.col("valid") > 0) & (~few | F.col("use_available"))
    timed = F.col("op").isin("latest", "earliest")
    late = F.array_max(F.transform("_ok", lambda x: F.struct(x["at"], -x["ladder"], x.alias("g"))))["g"]
    early = F.array_min(F.transform("_ok", lambda x: F.struct(x["first"], x["ladder"], x.alias("g"))))["g"]
    low = F.array_min(F.transform("_ok", lambda x: F.struct(x["ladder"], x.alias("g"))))["g"]
    picked = F.when(F.col("op") == "latest", late).when(F.col("op") == "earliest", early).otherwise(low)
    v = F.transform("_ok", lambda x: x["value"])
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    pooled = F.when(F.col("op") == documents.POOLS[0], total / F.nullif("valid", F.lit(0))).when(F.col("op") == documents.POOLS[1], F.array_min(v)).when(F.col("op") == documents.POOLS[2], F.array_max(v)).otherwise(total)
    one = one.withColumn("_pick", F.when(~pool, picked)).withColumn("value", F.when(there, F.when(pool, pooled).otherwise(F.col("_pick.value")))).withColumn("selected", F.when(there & ~pool, F.col("_pick.group")))
    status = F.when(~there, "no_data").when(pool, "calculated").when(timed | (F.col("_pick.ladder") == F.col("_top")), "direct").otherwise("fallback")
    ranked = F.array_sort(F.transform("_names", lambda x: F.struct(rank(x).alias("ladder"), x["group"].alias("group"))))
    before = F.transform(F.filter(ranked, lambda x: x["ladder"] < F.col("_pick.ladder")), lambda x: F.concat(F.lit("preferred_source_unavailable:"), x["group"]))
    skipped = F.when(there & ~pool & ~timed & (F.col("_pick.ladder") > F.col("_top")), before)
    other = F.array_compact(F.array(F.when(few, "insufficient_sources"), F.when(there & (F.col("op") == documents.POOLS[3]), "cross_source_sum")))
    warned = F.concat(other, F.coalesce(skipped, F.array().cast("array<string>")))
    return one.withColumn("status", status).withColumn("warnings", warned).drop("_pick", "_top")


def _followed(own: DataFrame, leaders: DataFrame) -> DataFrame:
    """Results of followers: the leader's group where it is valid here; else their own strategy, a pick as fallback, a pool as calculated."""
    lead = leaders.select("owner", F.col("metric").alias("follow"), "window_key", F.col("selected").alias("_led"))
    out = own.join(lead, ["owner", "follow", "window_key"], "left")
    met = F.get(F.filter("_ok", lambda x: x["group"] == F.col("_led")), F.lit(0))
    out = out.withColumn("_met", met)
    ok = F.col("_met").isNotNull()
    status = F.when(ok, "direct").when(F.col("status") == "direct", "fallback").otherwise(F.col("status"))
    lost = F.concat(F.array(F.concat_ws(":", F.lit("follow_unavailable"), F.col("_led"))), F.col("warnings"))
    return out.withColumns({"value": F.when(ok, F.col("_met.value")).otherwise(F.col("value")), "selected": F.when(ok, F.col("_met.group")).otherwise(F.col("selected")), "status": status, "warnings": F.when(ok, F.array().cast("array<string>")).otherwise(lost)}).drop("_led", "_met").select(own.columns)


def _composed(hours: DataFrame) -> DataFrame:
    """Days that are sums of their hours, each hour from the group that it picks: the first valid one, or the first of those with most."""
    most = F.array_min(F.transform("_ok", lambda x: F.struct((-x["value"]).alias("v"), x["ladder"].alias("ladder"), x["group"].alias("group"))))
    h = hours.withColumn("_top", F.when((F.col("compose") == "max") & (F.col("valid") > 0), most))
    h = h.withColumn("value", F.when(F.col("_top").isNotNull(), -F.col("_top.v")).otherwise(F.col("value"))).withColumn("selected", F.when(F.col("_top").isNotNull(), F.col("_top.group")).otherwise(F.col("selected")))
    each = h.select("rule", "date", F.explode("_ok").alias("x")).groupBy("rule", "date", "x.group").agg(F.sum("x.value").alias("v")).groupBy("rule", "date").agg(F.max("v").alias("_most"))
    d = h.groupBy("rule", "date").agg(
        *[F.first(c).alias(c) for c in ("owner", "metric", "op", "least", "use_available", "follow", "compose")], F.min("start").alias("start"), F.max("end").alias("end"), settled(F.sum("value")).alias("value"),
        F.count_distinct("selected").alias("_n"), F.max("selected").alias("_one"), F.count_if(F.col("status") == "fallback").alias("_fell"), F.max("valid").alias("valid"),
    ).join(each, ["rule", "date"], "left")
    status = F.when(F.col("_n") == 0, "no_data").when(F.col("_n") > 1, "calculated").when((F.col("_fell") == 0) & (F.col("compose") != "max"), "direct").otherwise("fallback")
    over = (F.col("_n") > 1) & (F.col("value") > F.col("_most") + 1e-9)
    return d.select(
        "rule", F.col("date").cast("string").alias("window_key"), "owner", "metric", F.lit("local_day").alias("window"), "date", "start", "end", "op", "least", "use_available", "follow", "compose", F.lit(None).cast("string").alias("context"), "valid",
        F.lit(None).cast(hours.schema["_ok"].dataType).alias("_ok"), "value", F.when(F.col("_n") == 1, F.col("_one")).alias("selected"), status.alias("status"), F.when(over, F.array(F.lit("composite_exceeds_any_source"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def resolve(rules: DataFrame, catalogue: DataFrame, rows: DataFrame, sources: DataFrame, now: int, nights: DataFrame | None = None, events: DataFrame | None = None, name: str = "resolve") -> Resolution:
    """All rules over all rows, in one plan whatever the number of rules; followers take one more join for each step of their chain.

    A window is listed if any row of the rule's metric is in it, even one that no group takes; every group
    of the rule is listed in it.  Latest windows are listed for every date on which the owner has a row of
    the metric.  Rows of a metric without a rule, and rules without rows, give nothing; nulls in a source's
    field agree only with selectors that don't ask for it; repeated rows count as often as they are there.
    """
    scratch = Scratch(rules.sparkSession, name)
    # documents made of other rows are parsed once for each rule, not for each of those rows
    rules = scratch.save(rules.select("rule", "owner", "metric", "doc"))
    d = scratch.save(dispatch(rules, catalogue))
    at = F.lit(now)
    r = rows.withColumnRenamed("metric", "reads").join(d.drop("n_groups", "op", "least", "use_available", "follow", "compose", "contexts"), ["owner", "reads"])
    r = _gated(r.where((F.col("kind") != "daily_value") | F.col("window").isin("local_day", "latest", "reading")))
    chosen_by = scratch.save(predicates(rules))
    used = r.select("rule", "source_id")
    if events is not None:  # a workout's recorder counts by its group, whether or not it has rows of the metric
        asks = d.where(F.size("contexts") > 0).select("rule", "owner")
        used = used.unionByName(events.select("owner", "source_id").distinct().join(asks, "owner").select("rule", "source_id"))
    member = scratch.save(memberships(sources, used.distinct(), chosen_by))
    r = r.join(member, ["rule", "source_id"])
    placed = _windowed(r.where(~F.col("window").isin(*NIGHT)))
    if nights is not None:
        placed = placed.unionByName(_nightly(r.where(F.col("window").isin(*NIGHT)), nights))
    placed = scratch.save(placed.withColumn("pos", F.coalesce("pos", F.lit(-2))))

    values = group_values(placed.where("pos >= 0"), d)
    values = scratch.save(values)
    kinds = F.array(*[F.lit(k) for k in documents.WINDOWS])  # a kind as a number, so that windows are hashed and not sorted
    listed = placed.groupBy(*WINDOW).agg(*[F.first(c).alias(c) for c in ("owner", "date", "start", "end")], F.first(F.array_position(kinds, F.col("window"))).alias("_kind"))
    listed = listed.withColumn("window", F.get(kinds, (F.col("_kind") - 1).cast("int"))).drop("_kind")
    days = listed.where("window = 'latest'").select("owner", "date", "start", "end").distinct()
    values = values.where("window <> 'latest'").unionByName(_carried(values.where("window = 'latest'"), days, at))
    listed = _contexts(listed, events, member)
    names = chosen_by.where("pos >= 0").select("rule", F.struct("pos", "group").alias("g")).distinct().groupBy("rule").agg(F.array_sort(F.collect_list("g")).alias("_names"))
    own = _judged(values, at).groupBy(*WINDOW).agg(F.collect_list(F.struct(*_OWN)).alias("_own"))
    told = d.select("rule", "metric", "op", "least", "use_available", "follow", "compose", "contexts").join(names, "rule")
    # dealt by the rule, so that few small rules don't leave all windows to one task
    every = listed.join(own, WINDOW, "left").join(told.hint("shuffle_hash"), "rule")
    every = every.withColumn("_own", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType))).withColumn("_listed", _listed()).drop("contexts", "recorder")
    resolved = scratch.save(_chosen(every))
    groups = resolved.select(*WINDOW, "owner", "metric", "window", "date", "context", "_own", "_listed", F.inline("_names")).withColumn("_o", F.get(F.filter("_own", lambda x: x["pos"] == F.col("pos")), F.lit(0)))
    reason = F.when(F.col("_o").isNull(), "no_data").otherwise(F.col("_o.reason"))
    groups = groups.select("*", *[F.col(f"_o.{c}").alias(c) for c in ("value", "n", "at")], F.coalesce("_o.coverage", F.lit(0.0)).alias("coverage"), reason.alias("reason"), _ladder(F.col("pos"), F.col("group")).alias("ladder"))
    chosen = resolved.drop("_own", "_names", "_listed")
    done = chosen.where("follow is null and compose is null").unionByName(_composed(chosen.where("compose is not null")))
    chain = documents.leaders(d.select("metric", "follow").distinct(), f"{name}-chain").groupBy("metric").agg(F.max("steps").alias("steps"))
    depth = chain.agg(F.max("steps")).first()[0] or 0
    for step in range(1, depth + 1):
        done = scratch.save(done)
        due = chosen.where("follow is not null").join(chain.where(F.col("steps") == step).select("metric"), "metric", "left_semi")
        done = done.unionByName(_followed(due.select(chosen.columns), done))
    picked = done.select(*WINDOW, F.col("selected").alias("_sel"), F.col("status").alias("_st"), F.col("op").alias("_op"))
    shown = groups.join(picked, WINDOW, "left")
    won = F.col("reason").isNull() & ((F.col("_sel") == F.col("group")) | ((F.col("_st") == "calculated") & F.col("_op").isin(*documents.POOLS)))
    shown = shown.withColumn("status", F.when(F.coalesce(won, F.lit(False)), "selected").when(F.col("reason").isNull(), "unused").otherwise(group_status(F.col("reason"))))
    return Resolution(shown.select("rule", "owner", "metric", "window", "window_key", "date", "pos", "group", "ladder", "context", "value", "n", "at", "coverage", "reason", "status"), done.select("rule", "owner", "metric", "window", "window_key", "date", "start", "end", "value", "selected", "status", "context", "warnings"))
