"""Queries over vendor payloads, which are built as JSON from the shared tables; the SQL computes the rows from the tables directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import normalize as nz
from strandline.plans.registry import query
from strandline.sources.tables import measurements, spread, table

_S = F.struct


def _json(*cols) -> F.Column:
    return F.to_json(_S(*cols))


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as measure groups: a weight, a pulse, for some a blood pressure, a temperature that counts from a thermometer only, and a type that nobody knows."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    m = lambda v, t, u: _S(v.cast("long").alias("value"), F.lit(t).alias("type"), F.lit(u).alias("unit"))
    key, size = F.col("p_partkey"), F.col("p_size")
    bp = F.when(key % 2 == 0, F.array(m(size + 100, 10, 0), m(size + 50, 9, 0)))
    measures = F.concat(F.array(m(key * 7, 1, -3), m(size + 40, 11, 0), m(key, 12, -1), m(key, 999, 0), m(key * 9, 1, -3), m(size, 155, 1)), F.coalesce(bp, F.array().cast("array<struct<value:bigint,type:int,unit:int>>")))
    group = _S(key.alias("grpid"), (key + 1_700_000_000).cast("long").alias("date"), F.when(key % 7 == 0, 2).otherwise(1).alias("category"), F.concat(F.lit("dev"), (key % 3).cast("string")).alias("deviceid"), F.when(key % 5 == 0, "Thermo").otherwise("Body").alias("model"), measures.alias("measures"))
    return p.select(key.cast("long").alias("raw_id"), F.lit("scale.measures").alias("stream"), _json(group.alias("measuregrp")).alias("body"))


_SCALE = """WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part WHERE p_partkey % 7 <> 0), r AS (
SELECT k, 'weight' AS metric, k * 7 / 1000.0 AS value, 'kg' AS unit FROM p UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 'bp_pulse' ELSE 'heart_rate' END, z + 40.0, 'bpm' FROM p UNION ALL SELECT k, 'body_temperature', k / 10.0, '°C' FROM p WHERE k % 5 = 0
UNION ALL SELECT k, 'vascular_age', z * 10.0, 'years' FROM p UNION ALL SELECT k, 'bp_systolic', z + 100.0, 'mmHg' FROM p WHERE k % 2 = 0 UNION ALL SELECT k, 'bp_diastolic', z + 50.0, 'mmHg' FROM p WHERE k % 2 = 0)
"""


@query("nz3_scale_measures", _SCALE + """SELECT k AS raw_id, metric, (k + 1700000000) * 1000000 AS start, CAST(value AS DOUBLE) AS value, unit, 'dev' || CAST(k % 3 AS VARCHAR) AS device, CASE WHEN metric LIKE 'bp_%' THEN 'bp_reading' WHEN metric = 'weight' THEN 'body_composition' END AS reading FROM r""", events=False)
def scale_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nz.scale_measures(scale(spark, sf_dir))
    return got.select("raw_id", "metric", "start", "value", "unit", "device", nz.reading_group(F.col("metric")).alias("reading"))


@query("nz4_daily_activity", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_custkey AS c, o_totalprice AS t, ['Europe/Berlin', 'America/New_York', 'Asia/Kolkata'][1 + o_orderkey % 3] AS z FROM orders),
r AS (SELECT *, 'steps' AS metric, CAST(c AS DOUBLE) AS v FROM o UNION ALL SELECT *, 'distance_walk_run', t FROM o WHERE k % 2 = 0 UNION ALL SELECT *, 'total_energy', t / 2 FROM o)
SELECT k AS raw_id, metric, epoch_us(CAST(d AS TIMESTAMP) AT TIME ZONE z) AS start, epoch_us(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE z) AS "end", round(v, 4) AS value FROM r""", events=False)
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    zone = F.element_at(F.array(F.lit("Europe/Berlin"), F.lit("America/New_York"), F.lit("Asia/Kolkata")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    values = F.map_filter(F.create_map(F.lit("steps"), F.col("o_custkey").cast("double"), F.lit("distance"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.lit("totalcalories"), F.col("o_totalprice") / 2, F.lit("other"), F.lit(1.0)), lambda k, v: v.isNotNull())
    body = _json(_S(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), zone.alias("timezone"), F.lit("d").alias("deviceid"), values.alias("values")).alias("activity"))
    got = nz.daily_activity(o.select(F.col("o_orderkey").cast("long").alias("raw_id"), body.alias("body")))
    return got.select("raw_id", "metric", "start", "end", F.round("value", 4).alias("value"))


@query("nz5_intraday", """, r AS (SELECT id, s, k, 'heart_rate' AS metric, value AS v, CAST(NULL AS BIGINT) AS e FROM m UNION ALL SELECT id, s, k, 'steps', CAST(k AS DOUBLE), (s // 1000000 + k) * 1000000 FROM m WHERE k > 0)
SELECT id AS raw_id, metric, CASE WHEN e IS NULL THEN 'sample' ELSE 'interval' END AS kind, s // 1000000 * 1000000 AS start, e AS "end", v AS value FROM r""")
def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    entry = _S(F.unix_seconds("start_at").alias("timestamp"), F.col("k").cast("double").alias("duration"), F.create_map(F.lit("heart_rate"), F.col("value"), F.lit("steps"), F.col("k").cast("double"), F.lit("odd"), F.lit(1.0)).alias("data"))
    got = nz.intraday(m.select(F.col("id").alias("raw_id"), _json(F.array(entry).alias("entries")).alias("body")))
    return got.select("raw_id", "metric", "kind", "start", "end", "value")


@query("nz6_wr8_sleep_records", """, r AS (SELECT id, s // 1000000 AS t, k FROM m WHERE k > 0)
SELECT id AS raw_id, t * 1000000 AS lo, (t + k * 60) * 1000000 AS hi, CASE WHEN id % 3 = 0 THEN 2 ELSE 3 END AS stages, CASE WHEN id % 2 = 0 THEN 'provider' ELSE 'stages' END AS basis,
  CASE WHEN id % 2 = 0 THEN k * 48 WHEN id % 3 = 0 THEN k * 20 ELSE k * 40 END AS asleep, CASE WHEN id % 2 = 1 THEN k * 20 END AS deep, CASE WHEN id % 2 = 1 THEN CASE WHEN id % 3 = 0 THEN 0 ELSE k * 20 END END AS rem, CASE WHEN id % 2 = 1 THEN k * 5 END AS awake FROM r""")
def sleep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights with totals of the provider, or summed from the stages of their own device."""
    m = spread(measurements(spark, sf_dir).where("k > 0").select("id", "start_at", "k"), "id")
    t, k = F.unix_seconds("start_at"), F.col("k")
    st = lambda a, b, state, model: _S((t + k * a).alias("startdate"), (t + k * b).alias("enddate"), F.lit(state).alias("state"), model.alias("model"))
    states = F.array(st(0, 5, 0, F.lit(1)), st(5, 25, 2, F.lit(1)), st(25, 45, 3, F.when(F.col("id") % 3 == 0, 9).otherwise(1)), st(45, 50, 77, F.lit(1)))
    data = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("total_sleep_time"), (k * 48).cast("double"), F.lit("deepsleepduration"), F.lit(-1.0)))
    body = _json(_S((F.col("id") + 1).alias("id"), t.alias("startdate"), (t + k * 60).alias("enddate"), F.lit(1).alias("model"), data.alias("data")).alias("summary"), states.alias("states"))
    got = nz.totals_from_stages(nz.sleep_record(m.select(F.col("id").alias("raw_id"), body.alias("body"))))
    return got.select("raw_id", "lo", "hi", F.size("stages").alias("stages"), "basis", "asleep", "deep", "rem", "awake")


@query("nz7_described_series", """, r AS (SELECT id, s // 1000000 AS t, CAST(k - 10 AS DOUBLE) AS v FROM m) SELECT id AS raw_id, t * 1000000 AS start, v AS value FROM r WHERE v >= 0""")
def described_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    turned = F.col("id") % 2
    d = lambda key, i: _S(F.lit(key).alias("key"), i.cast("int").alias("index"))
    t, v = (F.unix_seconds("start_at") * 1000).cast("double"), (F.col("k") - 10).cast("double")
    row = F.when(turned == 0, F.array(t, v)).otherwise(F.array(v, t))
    body = _json(F.array(d("timestamp", turned), d("stressLevel", 1 - turned)).alias("descriptors"), F.array(row, F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))).alias("values"))
    return nz.described_series(m.select(F.col("id").alias("raw_id"), body.alias("body")), "stress", "index", "stressLevel").select("raw_id", "start", "value")


@query("nz10_strap", """SELECT id AS raw_id, 'heart_rate' AS metric, s // 1000 * 1000 AS start, CAST(k AS DOUBLE) AS value FROM m WHERE k > 0 UNION ALL SELECT id, 'steps', s, CAST(7000 + k AS DOUBLE) FROM m WHERE id % 5 <> 0""")
def strap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    hr = m.select(F.col("id").alias("raw_id"), _json(F.array(_S(F.unix_millis("start_at").alias("time"), F.col("k").cast("double").alias("data"))).alias("values")).alias("body"))
    shown = F.when(F.col("id") % 5 == 0, "many").otherwise(F.format_number(F.lit(7000) + F.col("k"), 0))
    tiles = F.array(_S(F.lit("OTHER").alias("id"), F.lit("1").alias("status")), _S(F.lit("STEPS").alias("id"), shown.alias("status")))
    steps = m.select(F.col("id").alias("raw_id"), _json(F.lit("2024-01-01").alias("date"), F.unix_micros("start_at").alias("start"), F.unix_micros("end_at").alias("end"), tiles.alias("tiles")).alias("body"))
    return nz.strap_heart_rate(hr).unionByName(nz.strap_steps(steps)).select("raw_id", "metric", "start", "value")


def phone(m: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in ("StepCount", "HeartRate", "HeartbeatSeries", "OxygenSaturation", "Unknown")]), (F.col("id") % 5 + 1).cast("int"))
    uuid = F.concat(F.lit("ab"), F.col("id").cast("string"))
    beats = F.when(F.col("id") % 5 == 2, F.array(F.lit(0.0), F.lit(0.5), F.lit(1.25)))
    sample = _S(uuid.alias("uuid"), F.unix_micros("start_at").alias("start"), F.unix_micros("end_at").alias("end"), F.when(F.col("id") % 5 != 2, F.col("value")).alias("value"), F.lit("p").alias("device"), beats.alias("beats"))
    gone = F.when(F.col("id") % 4 == 0, F.array(_S(uuid.alias("uuid")))).otherwise(F.array(_S(F.lit("").alias("uuid"))))
    return m.select(F.col("id").alias("raw_id"), _json(kind.alias("type"), F.array(sample).alias("samples"), gone.alias("deleted")).alias("body"))


@query("nz11_phone_pages", """SELECT id AS raw_id, ['steps', 'heart_rate', '', 'spo2'][1 + id % 5] AS metric, s AS start, CASE WHEN id % 5 = 0 THEN e END AS "end", round(CASE WHEN id % 5 = 3 THEN value * 100 ELSE value END, 6) AS value, 'AB' || CAST(id AS VARCHAR) AS external_id FROM m WHERE id % 5 IN (0, 1, 3)
UNION ALL SELECT id, 'rr_interval', s + o, NULL, v, 'AB' || CAST(id AS VARCHAR) || '#' || CAST(n AS VARCHAR) FROM m, (VALUES (500000, 500.0, 1), (1250000, 750.0, 2)) t(o, v, n) WHERE id % 5 = 2""")
def phone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.phone_page(phone(measurements(spark, sf_dir))).select("raw_id", "metric", "start", "end", F.round("value", 6).alias("value"), "external_id")


@query("nz11_phone_tombstones", """SELECT id AS raw_id, 'AB' || CAST(id AS VARCHAR) AS external_id FROM m WHERE id % 4 = 0""")
def phone_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.phone_tombstones(phone(measurements(spark, sf_dir))).select("raw_id", "external_id")


@query("nz13_export_ids", """SELECT id, substring(sha256('HR' || chr(0) || CAST(s AS VARCHAR) || chr(0) || CAST(e AS VARCHAR) || chr(0) || CAST(k AS VARCHAR) || ' bpm' || chr(0) || source || chr(0) || '<dev: >'), 1, 32) AS export_id FROM m""")
def export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    device = F.concat(F.lit("<dev: 0x"), F.hex("id"), F.lit(">"))
    return m.select("id", nz.export_id(F.lit("HR"), F.unix_micros("start_at"), F.unix_micros("end_at"), F.col("k"), F.lit("bpm"), F.col("source"), device).alias("export_id"))


@query("nz14_manual_entries", """SELECT id AS raw_id, 'k' || CAST(id AS VARCHAR) AS external_id, CASE WHEN id % 2 = 0 THEN 'interval' ELSE 'sample' END AS kind, s // 1000000 * 1000000 AS start, CASE WHEN id % 2 = 0 THEN e // 1000000 * 1000000 END AS "end", value FROM m WHERE id % 3 <> 0""")
def manual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = _json(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 != 0, "weight").alias("metric"), at("start_at").alias("start"), F.when(F.col("id") % 2 == 0, at("end_at")).alias("end"), "value", F.lit("kg").alias("unit"))
    return nz.manual_entry(m.select(F.col("id").alias("raw_id"), body.alias("body"))).select("raw_id", "external_id", "kind", "start", "end", "value")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several streams, some broken, some of a stream that has no normalizer."""
    s = scale(spark, sf_dir).withColumn("body", F.when(F.col("raw_id") % 11 == 0, F.lit("{broken")).otherwise(F.col("body")))
    other = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).cast("long").alias("raw_id"), F.lit("ring.temperature").alias("stream"), F.lit("{}").alias("body"))
    return s.union(other)


# the shapes that a scale's payloads have, with and without a blood pressure the same; those of a part whose key ends in 3 have another field
_STRAYS = "p_partkey % 10 = 3"


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = payloads(spark, sf_dir)
    return raw.withColumn("body", F.when((F.col("raw_id") % 10 == 3) & (F.col("stream") == "scale.measures"), F.regexp_replace("body", r"^\{", '{"more":1,')).otherwise(F.col("body")))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.functions.shape import shape_fingerprint

    return scale(spark, sf_dir).select("stream", shape_fingerprint("body").alias("shape")).distinct()


@query("nz1_normalized_streams", _SCALE + "SELECT 'scale.measures' AS normalizer, CAST(2 AS INTEGER) AS version, metric, count(*) AS n, round(sum(value), 3) AS total FROM r WHERE k % 11 <> 0 AND k % 10 <> 3 GROUP BY ALL", events=False)
def normalized_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by stream and shape, read once; those of another shape give nothing."""
    got = nz.normalize(_shaped(spark, sf_dir), _shapes(spark, sf_dir))
    return got.groupBy("normalizer", "version", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("wr13_quarantine", f"""SELECT CASE WHEN p_partkey % 11 = 0 OR {_STRAYS} THEN 'unknown_shape' ELSE 'no_output' END AS reason, count(*) AS n FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR {_STRAYS} GROUP BY ALL UNION ALL SELECT 'no_normalizer', count(*) FROM supplier""", events=False)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = nz.routed(_shaped(spark, sf_dir), _shapes(spark, sf_dir))
    return nz.unreadable(held, nz.normalize(held)).groupBy("reason").agg(F.count("*").alias("n"))


@query("wr12_reprocessed", _SCALE + "SELECT k AS raw_id FROM (SELECT DISTINCT k FROM r) WHERE k % 3 = 0 AND k % 11 <> 0", events=False)
def reprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that an older version has normalized."""
    raw = payloads(spark, sf_dir)
    stored = nz.normalize(raw).withColumn("version", F.when(F.col("raw_id") % 3 == 0, 1).otherwise(F.col("version")))
    return nz.outdated(raw, stored).select("raw_id")


@query("nz2_output_problems", """SELECT CASE WHEN source = 'error' THEN 'unknown_metric' WHEN id % 13 = 0 THEN 'bad_value' WHEN id % 2 = 0 AND k = 0 THEN 'no_end' WHEN id % 2 = 0 AND id % 10 = 4 THEN 'reversed' ELSE 'fine' END AS problem, count(*) AS n FROM m GROUP BY ALL""")
def output_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    s = F.unix_micros("start_at")
    end = F.when((F.col("id") % 2 == 0) & (F.col("k") > 0), F.when(F.col("id") % 10 == 4, s - 1).otherwise(F.unix_micros("end_at")))
    rows = m.select(F.col("source").alias("metric"), F.when(F.col("id") % 2 == 0, "interval").otherwise("sample").alias("kind"), F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("value")).alias("value"), s.alias("start"), end.alias("end"))
    return rows.groupBy(F.coalesce(nz.problem(("view", "click", "purchase", "signup")), F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("ky2_record_keys", """SELECT id, substring(sha256('v1|acme|' || CASE WHEN owner % 2 = 0 THEN 'acc' || CAST(owner AS VARCHAR) ELSE 'conn:c' || CAST(owner AS VARCHAR) END || CASE WHEN id % 3 = 0 THEN '|rec|x' || CAST(id AS VARCHAR) || '|' || source ELSE '|' || source || '|sample|' || CAST(s AS VARCHAR) || '|' || CASE WHEN id % 4 = 0 THEN CAST(e AS VARCHAR) ELSE '' END END), 1, 32) AS key FROM m""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    natural = [F.col("source"), F.lit("sample"), F.unix_micros("start_at"), F.when(F.col("id") % 4 == 0, F.unix_micros("end_at"))]
    key = nz.record_key(F.lit("acme"), F.when(F.col("owner") % 2 == 0, text("acc", "owner")), text("c", "owner"), F.lit("rec"), F.when(F.col("id") % 3 == 0, text("x", "id")), F.col("source"), natural)
    return m.select("id", key.alias("key"))


@query("ig4_sanitized_requests", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'page,user' ELSE 'user' END AS params, 'Content-Type,user-agent' AS headers FROM orders""", events=False)
def sanitized_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    params = F.map_filter(F.create_map(*[x for k in ("user", "access_token", "Sig", "session_id", "api_key") for x in (F.lit(k), F.lit("v"))], F.lit("page"), F.when(F.col("o_orderkey") % 2 == 0, "1")), lambda k, v: v.isNotNull())
    headers = F.create_map(*[F.lit(x) for k in ("Content-Type", "Authorization", "user-agent", "X-Key") for x in (k, "v")])
    p, h = nz.sanitized(params, headers)
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return o.select("o_orderkey", names(p).alias("params"), names(h).alias("headers"))


@query("ig3_checked_batches", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/client/kind' WHEN 2 THEN '/items/0/key,/items/0/sha256' WHEN 3 THEN '/extra,/schema' ELSE '(body)' END AS pointers FROM part""", events=False)
def checked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with what is wrong with them, by place."""
    i = F.col("p_partkey") % 5
    item = _S(F.when(i == 2, "").otherwise("k").alias("key"), F.lit("2024-01-01T00:00:00Z").alias("sent_at"), F.sha2(F.when(i == 2, "other").otherwise(F.col("p_name")), 256).alias("sha256"), F.col("p_name").alias("body"))
    body = _json(F.when(i == 3, "ingest.v9").otherwise("ingest.v1").alias("schema"), _S(F.when(i == 1, "robot").otherwise("device").alias("kind"), F.lit("app-1").alias("name"), F.lit("1.0").alias("version")).alias("client"), F.lit("scale.measures").alias("stream"), F.array(item).alias("items"), F.when(i == 3, 1).alias("extra"))
    got = nz.checked_batches(table(spark, sf_dir, "part").select("p_partkey", F.when(i == 4, "[1, 2").otherwise(body).alias("body")))
    return got.select("p_partkey", F.array_join(F.array_sort(F.transform("errors", lambda e: F.when(e["pointer"] == "", "(body)").otherwise(e["pointer"]))), ",").alias("pointers"))


@query("nz8_watch_activities", """SELECT id AS raw_id, ['running', 'cycling', 'other', 'swimming', 'running'][1 + id % 5] AS sport, s // 1000000 * 1000000 AS lo, s // 1000000 * 1000000 + k * 30500000 AS hi, value AS distance, CASE WHEN id % 2 = 0 THEN 99.0 END AS calories FROM m WHERE k > 0 AND id % 7 <> 0""")
def watch_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(t) for t in ("running", "indoor_cycling", "juggling", "lap_swimming", "trail_running")]), (F.col("id") % 5 + 1).cast("int"))
    summary = F.create_map(F.lit("distance"), F.col("value"), F.lit("calories"), F.when(F.col("id") % 2 == 0, 99.0), F.lit("mood"), F.lit(1.0))
    body = _json((F.col("id") + 1).alias("activityId"), F.when(F.col("id") % 7 == 0, "soon").otherwise(F.date_format("start_at", "yyyy-MM-dd HH:mm:ss")).alias("startTimeGMT"), (F.col("k") * 30.5).alias("duration"), kind.alias("type"), summary.alias("summary"))
    got = nz.watch_activities(m.select(F.col("id").alias("raw_id"), body.alias("body")))
    return got.select("raw_id", "sport", "lo", "hi", F.col("values")["distance_walk_run"].alias("distance"), F.col("values")["active_energy"].alias("calories"))
