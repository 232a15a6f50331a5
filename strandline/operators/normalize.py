"""Vendor payloads to canonical rows: one DataFrame plan for each stream, JSON parsed by explicit schemas.

Every function takes ``raw(raw_id, body)`` and gives ``(raw_id, metric, kind, start, end, value, unit, device,
external_id, component)`` with instants in microseconds; a body that doesn't parse gives no rows and is
found by ``unreadable``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.shape import shape_fingerprint
from strandline.sources.scratch import Scratch

COLUMNS = ("raw_id", "metric", "kind", "start", "end", "value", "unit", "device", "external_id", "component")
KINDS = ("sample", "interval", "daily_value")
SECOND = 1_000_000

# Measure types of scales and cuffs with their metric and unit.
MEASURES = {
    1: ("weight", "kg"), 4: ("height", "m"), 5: ("fat_free_mass", "kg"), 6: ("body_fat_ratio", "%"), 8: ("fat_mass", "kg"), 9: ("bp_diastolic", "mmHg"), 10: ("bp_systolic", "mmHg"),
    11: ("heart_rate", "bpm"), 12: ("body_temperature", "°C"), 54: ("spo2", "%"), 71: ("body_temperature", "°C"), 73: ("skin_temperature", "°C"), 76: ("muscle_mass", "kg"), 77: ("hydration", "kg"),
    88: ("bone_mass", "kg"), 91: ("pulse_wave_velocity", "m/s"), 123: ("vo2max", "mL/kg/min"), 155: ("vascular_age", "years"),
}
# Fields of daily and intraday records with metric and unit; what lasts in an intraday record.
DAILY = {"steps": ("steps", "count"), "distance": ("distance_walk_run", "m"), "elevation": ("floors_climbed", "count"), "calories": ("active_energy", "kcal"), "totalcalories": ("total_energy", "kcal")}
INTRADAY = {"steps": ("steps", "count", True), "calories": ("active_energy", "kcal", True), "heart_rate": ("heart_rate", "bpm", False), "spo2_auto": ("spo2", "%", False)}
GROUPS = {"bp_reading": ("bp_systolic", "bp_diastolic", "bp_pulse"), "body_composition": ("weight", "fat_free_mass", "body_fat_ratio", "fat_mass", "muscle_mass", "hydration", "bone_mass")}


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    # an array of one, taken apart: the optimizer would parse the body again for every field that a later step reads
    return raw.select("raw_id", F.explode(F.array(F.from_json("body", schema))).alias("r")).where("r is not null")


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    none = {"end": "long", "device": "string", "unit": "string", "external_id": "string", "component": "string"}
    return df.select("raw_id", *[(columns[c] if c in columns else F.lit(None)).cast(none.get(c, "string")).alias(c) if c in none else columns[c].alias(c) for c in COLUMNS[1:]])


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def decimal(value: Column, unit: Column) -> Column:
    """``value`` times ten to the ``unit``; divided by a power of ten where that is negative, which gives the nearest double."""
    return F.when(unit >= 0, value * F.pow(F.lit(10.0), unit)).otherwise(value / F.pow(F.lit(10.0), -unit))


def scale_measures(raw: DataFrame) -> DataFrame:
    """Measure groups of scales and cuffs.  A pulse beside a blood pressure is its own metric; room temperature (type 12) counts only from a thermometer."""
    df = _parsed(raw, "measuregrp struct<grpid:long,date:long,category:int,deviceid:string,model:string,measures:array<struct<value:long,type:int,unit:int>>>").select("raw_id", "r.measuregrp.*")
    df = df.where("grpid <> 0 and date > 0 and category = 1")
    bp = F.exists("measures", lambda m: m["type"].isin(9, 10))
    df = df.select("*", bp.alias("bp"), F.posexplode("measures").alias("i", "m"))
    metric = F.when((F.col("m.type") == 11) & F.col("bp"), "bp_pulse").otherwise(_map({k: v[0] for k, v in MEASURES.items()})[F.col("m.type")])
    df = df.withColumn("metric", metric).where("metric is not null and (m.type <> 12 or model = 'Thermo')")
    # of a metric that comes twice the first counts
    first = df.groupBy("raw_id", "grpid", "metric").agg(F.min_by(F.struct("date", "deviceid", "m"), "i").alias("f"))
    unit = F.when(F.col("metric") == "bp_pulse", "bpm").otherwise(_map({v[0]: v[1] for v in MEASURES.values()})[F.col("metric")])
    return _rows(first, metric=F.col("metric"), kind=F.lit("sample"), start=F.col("f.date") * SECOND, value=decimal(F.col("f.m.value"), F.col("f.m.unit")), unit=unit, device=F.col("f.deviceid"), external_id=F.col("grpid").cast("string"), component=F.col("metric"))


def reading_group(metric: Column) -> Column:
    """The kind of reading that a metric is a component of, null for one that stands alone."""
    out = F.lit(None).cast("string")
    for kind, metrics in GROUPS.items():
        out = F.when(metric.isin(*metrics), kind).otherwise(out)
    return out


def _local_midnight(date: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(date.cast("timestamp"), zone))


def daily_activity(raw: DataFrame) -> DataFrame:
    """Daily totals over the local day of the record's own zone."""
    df = _parsed(raw, "activity struct<date:string,timezone:string,deviceid:string,values:map<string,double>>").select("raw_id", "r.activity.*").where("date is not null and timezone is not null")
    df = df.select("*", F.to_date("date").alias("d"), F.explode("values").alias("field", "v")).where(F.col("field").isin(*DAILY) & F.col("v").isNotNull())
    metric, unit = _map({k: v[0] for k, v in DAILY.items()})[F.col("field")], _map({k: v[1] for k, v in DAILY.items()})[F.col("field")]
    return _rows(df, metric=metric, kind=F.lit("daily_value"), start=_local_midnight(F.col("d"), F.col("timezone")), end=_local_midnight(F.date_add("d", 1), F.col("timezone")), value=F.col("v"), unit=unit, device=F.col("deviceid"), external_id=F.concat_ws(":", "date", F.coalesce("deviceid", F.lit(""))), component=metric)


def intraday(raw: DataFrame) -> DataFrame:
    """An hour's entries: fields that last become intervals of the entry's duration, which they need, the others samples."""
    df = _parsed(raw, "entries array<struct<timestamp:long,duration:double,data:map<string,double>>>").select("raw_id", F.explode("r.entries").alias("e")).where("e.timestamp > 0")
    df = df.select("raw_id", "e.timestamp", "e.duration", F.explode("e.data").alias("field", "v")).where(F.col("field").isin(*INTRADAY) & F.col("v").isNotNull())
    lasts = _map({k: v[2] for k, v in INTRADAY.items()})[F.col("field")]
    df = df.withColumn("lasts", lasts).where("not lasts or duration > 0")
    metric, unit = (_map({k: v[i] for k, v in INTRADAY.items()})[F.col("field")] for i in (0, 1))
    end = F.when(F.col("lasts"), (F.col("timestamp") + F.floor("duration")) * SECOND)
    return _rows(df, metric=metric, kind=F.when(F.col("lasts"), "interval").otherwise("sample"), start=F.col("timestamp") * SECOND, end=end, value=F.col("v"), unit=unit, external_id=F.col("timestamp").cast("string"), component=metric)


def described_series(raw: DataFrame, metric: str, unit: str, value_key: str) -> DataFrame:
    """Series as rows of numbers whose columns a list of descriptors names; a missing or negative value is no reading."""
    df = _parsed(raw, "descriptors array<struct<key:string,index:int>>, values array<array<double>>")
    at = lambda key: F.element_at(F.map_from_entries("r.descriptors"), F.lit(key))
    df = df.select("raw_id", at("timestamp").alias("ti"), at(value_key).alias("vi"), F.explode("r.values").alias("row"))
    df = df.select("raw_id", F.get("row", F.col("ti")).alias("t"), F.get("row", F.col("vi")).alias("v")).where("t is not null and v >= 0")
    start = F.col("t").cast("long") * 1000
    return _rows(df, metric=F.lit(metric), kind=F.lit("sample"), start=start, value=F.col("v"), unit=F.lit(unit), external_id=start.cast("string"), component=F.lit(metric))


def strap_heart_rate(raw: DataFrame) -> DataFrame:
    """Heart rate of a strap; 0 marks a gap."""
    df = _parsed(raw, "values array<struct<time:long,data:double>>").select("raw_id", F.explode("r.values").alias("x")).where("x.data > 0")
    return _rows(df, metric=F.lit("heart_rate"), kind=F.lit("sample"), start=F.col("x.time") * 1000, value=F.col("x.data"), unit=F.lit("bpm"), device=F.lit("strap"), external_id=F.col("x.time").cast("string"), component=F.lit("heart_rate"))


def strap_steps(raw: DataFrame) -> DataFrame:
    """A day's steps as shown on a screen: digits with thousands separators; other text is no count."""
    df = _parsed(raw, "date string, start long, end long, tiles array<struct<id:string,status:string>>")
    tile = F.get(F.filter("r.tiles", lambda t: t["id"] == "STEPS"), F.lit(0))
    df = df.select("raw_id", "r.date", "r.start", "r.end", F.regexp_replace(F.trim(tile["status"]), "[,.   ]", "").alias("digits")).where(F.col("digits").rlike("^[0-9]+$"))
    return _rows(df, metric=F.lit("steps"), kind=F.lit("daily_value"), start=F.col("start"), end=F.col("end"), value=F.col("digits").cast("double"), unit=F.lit("count"), device=F.lit("strap"), external_id=F.col("date"), component=F.lit("steps"))


# Types of a phone's samples.
PHONE = {"StepCount": ("steps", "count", "interval", 1.0), "HeartRate": ("heart_rate", "bpm", "sample", 1.0), "OxygenSaturation": ("spo2", "%", "sample", 100.0)}
_PAGE = "type string, samples array<struct<uuid:string,start:long,end:long,value:double,device:string,beats:array<double>>>, deleted array<struct<uuid:string>>"


def phone_page(raw: DataFrame) -> DataFrame:
    """Pages of a phone's samples by type; heart beats give one row each, ``<id>#<n>``, with the time since the beat before."""
    df = _parsed(raw, _PAGE).select("raw_id", "r.type", F.explode("r.samples").alias("s"))
    q = df.where(F.col("type").isin(*PHONE) & F.col("s.value").isNotNull())
    of = lambda i: _map({k: v[i] for k, v in PHONE.items()})[F.col("type")]
    kind = of(2)
    plain = _rows(q, metric=of(0), kind=kind, start=F.col("s.start"), end=F.when(kind == "interval", F.col("s.end")), value=F.col("s.value") * of(3), unit=of(1), device=F.col("s.device"), external_id=F.upper("s.uuid"), component=of(0))
    beats = df.where("type = 'HeartbeatSeries'").select("raw_id", "s", F.posexplode("s.beats").alias("i", "at")).where("i > 0")
    gap = (F.col("at") - F.get("s.beats", F.col("i") - 1)) * 1000
    series = _rows(beats, metric=F.lit("rr_interval"), kind=F.lit("sample"), start=F.col("s.start") + F.round(F.col("at") * SECOND).cast("long"), value=gap, unit=F.lit("ms"), device=F.col("s.device"), external_id=F.concat(F.upper("s.uuid"), F.lit("#"), F.col("i").cast("string")), component=F.lit("rr_interval"))
    return plain.unionByName(series)


def phone_tombstones(raw: DataFrame) -> DataFrame:
    """``(raw_id, type, external_id)`` of what a page says is deleted."""
    return _parsed(raw, _PAGE).select("raw_id", "r.type", F.explode("r.deleted").alias("d")).where("d.uuid <> ''").select("raw_id", "type", F.upper("d.uuid").alias("external_id"))


def manual_entry(raw: DataFrame) -> DataFrame:
    """Values typed in by their owner, keyed by the entry, so that one entry stays one record however often it comes."""
    df = _parsed(raw, "key string, metric string, start timestamp, end timestamp, value double, unit string").select("raw_id", "r.*").where("metric is not null and start is not null and value is not null")
    return _rows(df, metric=F.col("metric"), kind=F.when(F.col("end").isNull(), "sample").otherwise("interval"), start=F.unix_micros("start"), end=F.unix_micros("end"), value=F.col("value"), unit=F.col("unit"), external_id=F.col("key"), component=F.col("metric"))


def sleep_record(raw: DataFrame) -> DataFrame:
    """``(raw_id, external_id, lo, hi, stages, asleep, deep, light, rem, awake)`` of a night: states of its own device in order, totals in 0 to 86,400 seconds."""
    df = _parsed(raw, "summary struct<id:long,startdate:long,enddate:long,model:int,data:map<string,double>>, states array<struct<startdate:long,enddate:long,state:int,model:int>>").select("raw_id", "r.*")
    df = df.where("summary.id <> 0 and summary.startdate > 0 and summary.enddate > summary.startdate")
    names = _map({0: "awake", 1: "light", 2: "deep", 3: "rem"})
    mine = F.filter("states", lambda s: (F.coalesce(s["model"], F.lit(0)).isin(0) | (s["model"] == F.col("summary.model"))) & names[s["state"]].isNotNull() & (s["enddate"] > s["startdate"]))
    stages = F.transform(mine, lambda s: F.struct(names[s["state"]].alias("stage"), (s["startdate"] * SECOND).alias("lo"), (s["enddate"] * SECOND).alias("hi")))
    secs = lambda f: F.when(F.col("summary.data")[f].between(0, 86400), F.floor(F.col("summary.data")[f]))
    totals = {"asleep": "total_sleep_time", "deep": "deepsleepduration", "light": "lightsleepduration", "rem": "remsleepduration", "awake": "wakeupduration"}
    return df.select("raw_id", F.col("summary.id").cast("string").alias("external_id"), (F.col("summary.startdate") * SECOND).alias("lo"), (F.col("summary.enddate") * SECOND).alias("hi"), stages.alias("stages"), *[secs(f).alias(c) for c, f in totals.items()])


def totals_from_stages(sessions: DataFrame) -> DataFrame:
    """``sessions`` with the totals that the provider didn't give summed from stages; a stage that a session never reports stays null."""
    of = lambda *names: F.aggregate(F.filter("stages", lambda s: s["stage"].isin(*names)), F.lit(0).cast("long"), lambda a, s: a + F.floor((s["hi"] - s["lo"]) / SECOND))
    has = lambda *names: F.exists("stages", lambda s: s["stage"].isin(*names))
    none = F.col("asleep").isNull() & F.col("awake").isNull() & F.col("deep").isNull() & F.col("light").isNull() & F.col("rem").isNull()
    use = none & (F.size("stages") > 0)
    new = {"asleep": of("deep", "light", "rem", "asleep_unspecified"), "awake": F.when(has("awake"), of("awake")), **{c: F.when(has("deep", "light", "rem"), of(c)) for c in ("deep", "light", "rem")}}
    return sessions.select("*", use.alias("_use")).withColumn("basis", F.when(none, "stages").otherwise("provider")).withColumns({c: F.when(F.col("_use"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_use")


def export_id(kind: Column, start: Column, end: Column, value: Column, unit: Column, source: Column, device: Column) -> Column:
    """Id of a record that has none: 16 bytes, in hex, over what it says; instants by time, the device without its address."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [text(kind), text(start), text(end), F.concat(text(value), F.lit(" "), text(unit)), text(source), F.regexp_replace(text(device), "0x[0-9A-Fa-f]+", "")]
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)


Normalizer = Callable[[DataFrame], DataFrame]
#: Streams by name and version: a payload goes to the newest version of its stream.
STREAMS: dict[str, tuple[int, Normalizer]] = {
    "scale.measures": (2, scale_measures), "scale.activity": (1, daily_activity), "scale.intraday": (1, intraday), "strap.heart_rate": (1, strap_heart_rate), "strap.steps": (1, strap_steps),
    "phone.samples": (1, phone_page), "manual.entries": (1, manual_entry), "watch.stress": (1, lambda raw: described_series(raw, "stress", "index", "stressLevel")),
}


def routed(raw: DataFrame, shapes: DataFrame | None = None, name: str = "routed") -> DataFrame:
    """``raw(raw_id, stream, body)`` read once and written by ``route``: the stream whose normalizer takes it, or why none does.

    ``shapes(stream, shape)`` lists the shapes that a stream's payloads may have; a stream of the list takes those
    alone, and another shape is ``unknown_shape``.  Streams that aren't listed take any.  The fingerprint of a body
    is computed in that one pass.
    """
    known = F.col("stream").isin(*STREAMS)
    df = raw.select("raw_id", "stream", "body")
    route = F.when(~F.coalesce(known, F.lit(False)), "no_normalizer").otherwise(F.col("stream"))
    if shapes is not None:
        listed = shapes.groupBy("stream").agg(F.collect_set("shape").alias("_shapes"))  # a row for each stream that there is
        df = df.withColumn("_shape", shape_fingerprint("body")).join(listed, "stream", "left")
        bad = F.col("_shapes").isNotNull() & ~F.coalesce(F.array_contains("_shapes", F.col("_shape")), F.lit(False))
        route = F.when(~F.coalesce(known, F.lit(False)), "no_normalizer").when(bad, "unknown_shape").otherwise(F.col("stream"))
    folder = f"{Scratch(raw.sparkSession, name).root}/raw"
    df.select("raw_id", "stream", "body", route.alias("route")).write.partitionBy("route").parquet(folder)
    return raw.sparkSession.read.schema("raw_id long, stream string, body string, route string").parquet(folder)


def normalize(raw: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Rows of ``raw(raw_id, stream, body)`` by the normalizer of each stream; payloads without one give none (see ``unreadable``).

    ``raw`` is read once, and each normalizer reads its own part of what was routed.
    """
    held = routed(raw, shapes) if "route" not in raw.columns else raw
    parts = [f(held.where(F.col("route") == name).select("raw_id", "body")).withColumns({"normalizer": F.lit(name), "version": F.lit(v)}) for name, (v, f) in STREAMS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def problem(metrics: tuple[str, ...]) -> Column:
    """What is wrong with a canonical row, null if nothing: what the writer would refuse."""
    lasts = F.col("kind").isin("interval", "daily_value")
    return (
        F.when(~F.col("metric").isin(*metrics), "unknown_metric").when(~F.col("kind").isin(*KINDS), "unknown_kind").when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "bad_value")
        .when(F.col("start").isNull(), "no_start").when(lasts & F.col("end").isNull(), "no_end").when(F.col("end") < F.col("start"), "reversed").when((F.col("kind") == "sample") & F.col("end").isNotNull() & (F.col("end") > F.col("start")), "sample_with_span")
    )


def unreadable(held: DataFrame, normalized: DataFrame) -> DataFrame:
    """``(raw_id, stream, reason)`` of payloads, ``routed``, that no normalizer takes, whose shape none knows, or that gave nothing: kept apart, never lost."""
    stray = F.col("route").isin("no_normalizer", "unknown_shape")
    silent = held.where(~stray).join(normalized.select("raw_id"), "raw_id", "left_anti")
    return held.where(stray).select("raw_id", "stream", F.col("route").alias("reason")).union(silent.select("raw_id", "stream", F.lit("no_output").alias("reason")))


def outdated(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Payloads whose stored rows are of an older version than their stream's normalizer: the ones to run again."""
    newest = _map({name: v for name, (v, _) in STREAMS.items()})
    old = stored.groupBy("raw_id").agg(F.min("version").alias("_v"))
    return raw.join(old, "raw_id").where(F.col("_v") < newest[F.col("stream")]).drop("_v")


def record_key(provider: Column, account: Column, connection: Column, record: Column, external_id: Column, component: Column, natural: list[Column]) -> Column:
    """Key of a record: by its upstream id where it has one, else by what it says; an account that isn't known is its connection."""
    from strandline.functions.scalars import dedupe_key

    who = F.when(F.coalesce(account, F.lit("")) != "", account).otherwise(F.concat(F.lit("conn:"), connection))
    return F.when(F.coalesce(external_id, F.lit("")) != "", dedupe_key(F.lit("v1"), provider, who, record, external_id, component)).otherwise(dedupe_key(F.lit("v1"), provider, who, *natural))


#: Names of parameters that carry credentials.
SECRET = "(?i)token|secret|password|authorization|cookie|code|refresh|api.?key|auth|signature|^sig$|nonce|session|credential|private|otp|mfa|^key$|^state$"
# Headers that are kept.
KEPT_HEADERS = ("accept", "accept-encoding", "accept-language", "content-type", "if-modified-since", "if-none-match", "user-agent")


def sanitized(params: Column, headers: Column) -> tuple[Column, Column]:
    """Request parameters without credentials, and the headers that say nothing about anyone."""
    return F.map_filter(params, lambda k, v: ~k.rlike(SECRET)), F.map_filter(headers, lambda k, v: F.lower(k).isin(*KEPT_HEADERS))


_BATCH = "schema string, client struct<kind:string,name:string,version:string>, stream string, items array<struct<key:string,sent_at:string,sha256:string,body:string>>"


def checked_batches(batches: DataFrame) -> DataFrame:
    """``batches(id, body)`` with ``errors array<struct<pointer,detail>>``, empty for a batch that may be stored."""
    r = batches.withColumn("_b", F.from_json("body", _BATCH, {"mode": "PERMISSIVE"}))
    known = F.array(*[F.lit(k) for k in ("schema", "client", "stream", "items")])
    extra = F.array_except(F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")), known)
    err = lambda p, d: F.struct(p.alias("pointer"), F.lit(d).alias("detail"))
    one = lambda ok, p, d: F.when(~F.coalesce(ok, F.lit(False)), err(F.lit(p), d))
    items = F.transform(F.coalesce("_b.items", F.array().cast("array<struct<key:string,sent_at:string,sha256:string,body:string>>")), lambda x, i: F.array_compact(F.array(
        F.when(F.coalesce(F.length(x["key"]), F.lit(0)) == 0, err(F.concat(F.lit("/items/"), i.cast("string"), F.lit("/key")), "required")),
        F.when(F.try_to_timestamp(x["sent_at"]).isNull(), err(F.concat(F.lit("/items/"), i.cast("string"), F.lit("/sent_at")), "must be a date-time")),
        F.when(~F.coalesce(F.sha2(x["body"], 256) == x["sha256"], F.lit(False)), err(F.concat(F.lit("/items/"), i.cast("string"), F.lit("/sha256")), "doesn't match the body")),
    )))
    whole = F.when(F.json_object_keys("body").isNull(), F.array(err(F.lit(""), "invalid JSON"))).otherwise(F.concat(
        F.transform(extra, lambda k: err(F.concat(F.lit("/"), k), "unknown field")),
        F.array_compact(F.array(one(F.col("_b.schema") == "ingest.v1", "/schema", "must be ingest.v1"), one(F.col("_b.client.kind").isin("device", "importer", "collector"), "/client/kind", "must be device, importer or collector"),
            one(F.col("_b.client.name").rlike("^[A-Za-z0-9._-]{1,64}$"), "/client/name", "must be a name"), one(F.col("_b.stream").rlike(r"^[a-z0-9_]+(\.[a-z0-9_]+)+$") & (F.length("_b.stream") <= 64), "/stream", "must be a dotted lowercase name"),
            one(F.size("_b.items") > 0, "/items", "at least one item is required"))),
        F.flatten(items),
    ))
    return r.withColumn("errors", whole).drop("_b")


# Kinds of a watch's activities, and what an activity's summary measures.
SPORTS = {"running": "running", "trail_running": "running", "cycling": "cycling", "indoor_cycling": "cycling", "walking": "walking", "hiking": "hiking", "lap_swimming": "swimming"}
SUMMARY = {"distance": ("distance_walk_run", "m"), "calories": ("active_energy", "kcal"), "averageHR": ("heart_rate_average", "bpm")}


def watch_activities(raw: DataFrame) -> DataFrame:
    """``(raw_id, external_id, sport, lo, hi, values map)`` of a watch's activity summaries; an unknown kind is ``other``, and a summary without a time or length is none."""
    df = _parsed(raw, "activityId long, startTimeGMT string, duration double, type string, summary map<string,double>").select("raw_id", "r.*")
    lo = F.unix_micros(F.try_to_timestamp("startTimeGMT", F.lit("yyyy-MM-dd HH:mm:ss")))
    values = F.map_filter(F.coalesce("summary", F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*SUMMARY) & v.isNotNull())
    named = F.transform_keys(values, lambda k, _: _map({k_: v[0] for k_, v in SUMMARY.items()})[k])
    df = df.withColumn("lo", lo).where("activityId is not null and lo is not null and duration > 0")
    return df.select("raw_id", F.col("activityId").cast("string").alias("external_id"), F.coalesce(_map(SPORTS)[F.col("type")], F.lit("other")).alias("sport"), "lo", (F.col("lo") + F.round(F.col("duration") * SECOND).cast("long")).alias("hi"), named.alias("values"))
