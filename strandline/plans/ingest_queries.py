"""Queries over ingest and versions: keys, dates, units, upserts, chains, filters, pages and laboratory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.shape import shape_fingerprint
from strandline.operators import episodes, labs, writer
from strandline.plans.registry import query
from strandline.sources.pages import keyset_page
from strandline.sources.tables import measurements, table


@query("ky1_dedupe_key", """
SELECT id, substring(sha256(source || '|' || CAST(owner AS VARCHAR) || '|' || CAST(s AS VARCHAR) || '|' || replace(replace('a|' || source || chr(92), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')), 1, 32) AS dedupe_key FROM m""")
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("a|"), F.col("source"), F.lit("\\"))
    return measurements(spark, sf_dir).select("id", scalars.dedupe_key("source", "owner", F.unix_micros("start_at"), odd).alias("dedupe_key"))


@query("ld1_local_dates", f""", z AS (SELECT *, CASE WHEN id % 3 = 0 THEN k * 15 - 720 END AS off, CASE WHEN id % 3 = 1 THEN 'Asia/Tokyo' END AS own FROM m)
SELECT CAST(CASE WHEN off IS NOT NULL THEN CAST(make_timestamp(s + off * 60000000) AS DATE) ELSE CAST((make_timestamp(s) AT TIME ZONE 'UTC') AT TIME ZONE coalesce(own, zone) AS DATE) END AS DATE) AS local_date, count(*) AS n FROM z GROUP BY ALL""")
def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    off, own = F.when(F.col("id") % 3 == 0, F.col("k") * 15 - 720), F.when(F.col("id") % 3 == 1, "Asia/Tokyo")
    return m.groupBy(scalars.local_date(F.col("start_at"), off, own, F.col("zone")).alias("local_date")).agg(F.count("*").alias("n"))


@query("nz9_paired_offsets", """, z AS (SELECT s // 1000000 AS u, s // 1000000 + (k - 50) * 900 + CASE WHEN k % 10 = 0 THEN 7 ELSE 0 END AS l FROM m)
SELECT CAST(CASE WHEN (l - u) % 900 = 0 AND l - u BETWEEN -43200 AND 50400 THEN (l - u) // 60 END AS INTEGER) AS "offset", count(*) AS n FROM z GROUP BY ALL""")
def paired_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.unix_seconds("start_at")
    local = u + (F.col("k") - 50) * 900 + F.when(F.col("k") % 10 == 0, 7).otherwise(0)
    return measurements(spark, sf_dir).groupBy(scalars.paired_offset(u, local).alias("offset")).agg(F.count("*").alias("n"))


UNITS = (("mm", 0.001, 0.0), ("cm", 0.01, 0.0), ("in", 0.0254, 0.0), ("m", 1.0, 0.0))


@query("un1_units", "WITH u(unit, f, o) AS (VALUES " + ", ".join(f"('{u}', {f}, {o})" for u, f, o in UNITS) + """)
SELECT p_partkey, a.unit AS "from", b.unit AS "to", round((p_size * a.f + a.o - b.o) / b.f, 6) AS size FROM part JOIN u a ON a.unit = ['mm', 'cm', 'in', 'm'][1 + p_partkey % 4] CROSS JOIN u b""", events=False)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.createDataFrame(UNITS, "unit string, f double, o double")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(F.array(*[F.lit(n) for n, _, _ in UNITS]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("from"))
    a, b = u.toDF("from", "fa", "oa"), F.array(*[F.struct(F.lit(n).alias("to"), F.lit(f).alias("fb"), F.lit(o).alias("ob")) for n, f, o in UNITS])
    out = part.join(F.broadcast(a), "from").withColumn("b", F.explode(b)).select("*", "b.*")  # the units are a fixed list
    size = scalars.convert(F.col("p_size"), F.col("fa"), F.col("oa"), F.col("fb"), F.col("ob"))
    return out.select("p_partkey", "from", "to", F.round(size, 6).alias("size"))


_CHAIN = """, v AS (SELECT id, owner, source, d, s, value, lead(id) OVER w AS superseded_by, row_number() OVER w AS version, count(*) OVER (PARTITION BY owner, source, d) AS n FROM m WINDOW w AS (PARTITION BY owner, source, d ORDER BY s, id))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.successors(measurements(spark, sf_dir), ["owner", "source", "local_date"], "start_at")


@query("wr4_se4_version_chains", _CHAIN + """
SELECT id, superseded_by, CAST(version AS INTEGER) AS version, n - version AS depth FROM v""")
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("id", "superseded_by", "version", "depth")


@query("sc1_active_rows", _CHAIN + """
SELECT id, owner, value FROM v WHERE superseded_by IS NULL AND id % 13 <> 0""")
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("superseded_by is null and id % 13 <> 0").select("id", "owner", "value")


@query("sr12_prunable", _CHAIN + """
SELECT id FROM v WHERE superseded_by IS NOT NULL AND id % 4 <> 0""")
def prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return writer.prunable(v, v.where("id % 4 = 0")).select("id")


_TWO = """, a AS (SELECT owner * 100000 + k AS key, max_by(value, (s, id)) AS value, max_by(source, (s, id)) AS source FROM m WHERE id % 2 = 0 GROUP BY ALL),
b AS (SELECT owner * 100000 + k AS key, max_by(CASE WHEN id % 3 = 0 THEN value END, (s, id)) AS value, max_by(source, (s, id)) AS source FROM m WHERE id % 5 < 3 GROUP BY ALL)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = measurements(spark, sf_dir).withColumn("key", F.col("owner") * 100_000 + F.col("k"))
    at = F.struct("start_at", "id")
    # null values count too: the struct keeps them
    last = lambda df, v: df.groupBy("key").agg(F.max_by(F.struct(v.alias("value"), "source"), at).alias("r")).select("key", "r.*")
    return last(m.where("id % 2 = 0"), F.col("value")), last(m.where("id % 5 < 3"), F.when(F.col("id") % 3 == 0, F.col("value")))


_TWO_SQL = _TWO.replace("max_by(CASE WHEN id % 3 = 0 THEN value END, (s, id)) AS value", "CASE WHEN max_by(id, (s, id)) % 3 = 0 THEN max_by(value, (s, id)) END AS value")


@query("wr1_upsert", _TWO_SQL + """
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'keep' WHEN a.key IS NULL THEN 'insert' WHEN a.value IS NOT DISTINCT FROM b.value AND a.source IS NOT DISTINCT FROM b.source THEN 'unchanged' ELSE 'supersede' END AS action
FROM a FULL JOIN b ON a.key = b.key""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return writer.upsert(a, b, "key", ["value", "source"])


@query("wr9_dirty_dates", """, a AS (SELECT owner, d, id, value FROM m WHERE id % 9 <> 0), b AS (SELECT owner, d, id, CASE WHEN id % 50 = 1 THEN value + 1 ELSE value END AS value FROM m)
SELECT DISTINCT b.owner, b.d AS local_date FROM b LEFT JOIN a ON a.id = b.id WHERE a.id IS NULL OR a.value <> b.value""")
def dirty_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    after = m.withColumn("value", F.when(F.col("id") % 50 == 1, F.col("value") + 1).otherwise(F.col("value")))
    return writer.dirty_dates(m.where("id % 9 <> 0"), after, ["owner", "local_date"], ["id", "value"])


@query("wr5_wr6_tombstones", """, r AS (SELECT id, CAST(owner AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '#' || CAST(k AS VARCHAR) ELSE '' END AS ext FROM m)
SELECT id, CAST(split_part(ext, '#', 1) AS BIGINT) % 7 = 0 AS deleted FROM r""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    rows = m.select("id", F.concat(F.col("owner").cast("string"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")).alias("ext"))
    deleted = m.where("owner % 7 = 0").select(F.col("owner").cast("string").alias("ext"))
    return writer.tombstones(rows, deleted, "ext").select("id", "deleted")


@query("wr2_first_of_payload", """, p AS (SELECT *, owner * 1000 + k AS key FROM m)
SELECT key, min(id) AS id, count(DISTINCT value) > 1 AS conflict FROM p GROUP BY key""")
def first_of_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumn("key", F.col("owner") * 1000 + F.col("k"))
    return writer.first_of_payload(rows, "key", "id", ["value"]).select("key", "id", "conflict")


@query("wr7_flags", """
SELECT flags | CASE WHEN value NOT BETWEEN 1 AND 200 THEN 4 ELSE 0 END | CASE WHEN source = 'error' THEN 8 ELSE 0 END AS flags, count(*) AS n FROM m GROUP BY ALL""")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("flags").bitwiseOR(F.when(~F.col("value").between(1, 200), 4).otherwise(0)).bitwiseOR(F.when(F.col("source") == "error", 8).otherwise(0))
    return measurements(spark, sf_dir).groupBy(out.alias("flags")).agg(F.count("*").alias("n"))


@query("ig1_raw_versions", """, p AS (SELECT owner, id, source, lag(source) OVER (PARTITION BY owner ORDER BY id) AS old FROM m), n AS (SELECT * FROM p WHERE old IS NULL OR old <> source)
SELECT owner, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY id) AS INTEGER) AS version, lag(id) OVER (PARTITION BY owner ORDER BY id) AS supersedes FROM n""")
def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).select("owner", "id", F.sha2("source", 256).alias("sha"))
    return writer.raw_versions(rows, ["owner"], ["id"], "sha").select("owner", "id", "version", "supersedes")


_P = ["CAST('$.\"k\":number' || chr(10) || '$:object' AS VARCHAR)", "'$.\"a\":object' || chr(10) || '$.\"a.b\":string' || chr(10) || '$:object'", "'$.\"a\".\"b\":string' || chr(10) || '$.\"a\":object' || chr(10) || '$:object'",
  "'$.\"v\":array' || chr(10) || '$.\"v\"[].\"x\":boolean' || chr(10) || '$.\"v\"[]:null' || chr(10) || '$.\"v\"[]:object' || chr(10) || '$:object'"]


@query("ig2_shapes", "SELECT 'v1:' || sha256(CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_P)) + """ END) AS shape, count(*) AS n FROM events GROUP BY ALL""", events=False)
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the shapes of the events' properties, three of four rewritten so that keys, arrays and nesting differ."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id") % 4
    doc = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit('{"a.b":"'), "event_type", F.lit('","a":{}}')))
    doc = doc.when(i == 2, F.concat(F.lit('{"a":{"b":"'), "event_type", F.lit('"}}'))).otherwise('{"v":[{"x":true},null,{"x":false}]}')
    return e.groupBy(shape_fingerprint(doc).alias("shape")).agg(F.count("*").alias("n"))


@query("ig5_ig6_batch_status", """
SELECT owner, CASE WHEN count(*) FILTER (flags & 2 <> 0) > 0 THEN 'failed' WHEN count(*) FILTER (flags & 1 <> 0) > 0 THEN 'pending' ELSE 'done' END AS status FROM m GROUP BY owner""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = measurements(spark, sf_dir).groupBy("owner").agg(F.count_if(F.col("flags").bitwiseAND(2) != 0).alias("f"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("s"))
    return counts.select("owner", scalars.raw_status(F.col("f"), F.col("s")).alias("status"))


@query("nz12_islands", """, x AS (SELECT * FROM m WHERE source IN ('view', 'signup')), i AS (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT owner, CAST(island AS BIGINT) AS island, min(s) AS lo, max(e) AS hi, count(*) AS pieces FROM j GROUP BY ALL""")
def sleep_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).where("source in ('view', 'signup')")
    return episodes.fragments(m.select("owner", F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi")), ["owner"], gap=7_200_000_000)


@query("nz15_nz16_source_filter", """, f AS (SELECT *, CASE WHEN owner % 20 = 1 THEN source <> 'error' WHEN source LIKE '%ick' OR source LIKE 'sign%' THEN false ELSE true END AS take FROM m)
SELECT source, count(*) AS ignored, min(s) AS first_at, max(s) AS last_at FROM f WHERE NOT take GROUP BY ALL""")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    choice = F.when(F.col("owner") % 20 == 1, F.col("source") != "error")
    by_default = F.when(F.col("source").like("%ick") | F.col("source").like("sign%"), F.lit(False))
    ignored = m.where(~F.coalesce(choice, by_default, F.lit(True)))
    return ignored.groupBy("source").agg(F.count("*").alias("ignored"), F.min(F.unix_micros("start_at")).alias("first_at"), F.max(F.unix_micros("start_at")).alias("last_at"))


@query("sc3_filtered_scan", """
SELECT id, owner, source, value FROM m WHERE source IN ('view', 'error') AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value >= 20 AND flags = 0""")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.sources.pages import filtered

    return filtered(measurements(spark, sf_dir), sources=["view", "error"], dates=("2024-01-05", "2024-01-20"), low=20.0, flags=0).select("id", "owner", "source", "value")


@query("sc8_keyset_page", """
SELECT id, s AS "at" FROM m WHERE s > 1705000000000000 OR (s = 1705000000000000 AND id > 5) ORDER BY s, id LIMIT 101""")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).select("id", F.unix_micros("start_at").alias("at"))
    return keyset_page(rows, ["at", "id"], (1_705_000_000_000_000, 5), 100)  # a page is a page


LAB_UNITS = (("glucose", "mg/dl", 1 / 18.0, 0.0), ("hba1c", "%", 10.93, -23.5))


@query("lb1_lab_units", """, l AS (SELECT id, ['glucose', 'hba1c', 'ferritin', 'nothing'][1 + k % 4] AS code, value, ['mmol/L', 'mg/dL', '%', 'mmol/mol', 'ug / L'][1 + id % 5] AS unit FROM m),
c AS (SELECT *, CASE code WHEN 'glucose' THEN 'mmol/l' WHEN 'hba1c' THEN 'mmol/mol' WHEN 'ferritin' THEN 'ug/l' END AS canon, replace(lower(unit), ' ', '') AS u FROM l)
SELECT id, CASE WHEN canon IS NULL THEN 'unknown' WHEN u = canon THEN 'canonical' WHEN (code = 'glucose' AND u = 'mg/dl') OR (code = 'hba1c' AND u = '%') THEN 'convertible' ELSE 'refused' END AS state,
  round(CASE WHEN u = canon THEN value WHEN code = 'glucose' AND u = 'mg/dl' THEN value / 18.0 WHEN code = 'hba1c' AND u = '%' THEN value * 10.93 - 23.5 END, 5) AS result FROM c""")
def lab_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    rows = measurements(spark, sf_dir).select("id", pick(("glucose", "hba1c", "ferritin", "nothing"), F.col("k") % 4).alias("code"), "value", pick(("mmol/L", "mg/dL", "%", "mmol/mol", "µg / L"), F.col("id") % 5).alias("unit"))
    analytes = spark.createDataFrame([("glucose", "mmol/L"), ("hba1c", "mmol/mol"), ("ferritin", "ug/L")], "code string, canonical_unit string")
    return labs.canonical(rows, analytes, spark.createDataFrame(LAB_UNITS, "code string, unit_key string, factor double, offset double")).select("id", "state", F.round("result", 5).alias("result"))


@query("lb3_lab_warnings", """, l AS (SELECT id, CASE WHEN k % 10 <> 0 THEN source END AS code, d, CASE WHEN id % 17 <> 0 THEN value END AS value, 5.0 AS low, 100.0 AS high, owner FROM m),
t AS (SELECT *, count(*) OVER (PARTITION BY code, d) > 1 AS twice FROM l)
SELECT id, array_to_string(list_filter([CASE WHEN code IS NULL THEN 'no_analyte' END, CASE WHEN value IS NULL THEN 'no_value' END, CASE WHEN value < low THEN 'below_range' END, CASE WHEN value > high THEN 'above_range' END,
  CASE WHEN twice AND code IS NOT NULL THEN 'repeated_in_run' END, CASE WHEN code = 'view' AND d = DATE '2024-01-15' THEN 'already_confirmed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM t""")
def lab_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    rows = m.select("id", F.when(F.col("k") % 10 != 0, F.col("source")).alias("code"), F.col("local_date").alias("date"), F.when(F.col("id") % 17 != 0, F.col("value")).alias("value"), F.lit(5.0).alias("low"), F.lit(100.0).alias("high"))
    confirmed = rows.where("code = 'view' and date = date '2024-01-15'")
    return labs.warnings(rows, confirmed).select("id", F.array_join("warnings", ",").alias("warnings"))


@query("lb_numbers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN 1.5 ELSE NULL END AS value, CASE WHEN p_partkey % 4 = 2 THEN '<' END AS comparator FROM part""", events=False)
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 4 == 0, F.format_number("p_retailprice", 2)).when(F.col("p_partkey") % 4 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 4 == 2, "< 1,5").otherwise("n/a")
    return p.select("p_partkey", F.get(scalars.numbers_of(text), F.lit(0)).alias("value"), scalars.comparator(text).alias("comparator"))


@query("st23_cache_differences", """, v AS (SELECT owner, d, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL), c AS (SELECT owner, d, n + CASE WHEN owner % 40 = 0 THEN 1 ELSE 0 END AS n FROM v WHERE owner % 25 <> 1)
SELECT owner, d AS local_date, n, 'stored' AS side FROM c WHERE owner % 40 = 0 UNION ALL SELECT owner, d, n, 'live' FROM v WHERE owner % 40 = 0 OR owner % 25 = 1
UNION ALL SELECT owner, d, n, 'none' FROM v WHERE false""")
def cache_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.operators.strategy import differences

    live = measurements(spark, sf_dir).groupBy("owner", "local_date").agg(F.count("*").alias("n"))
    stored = live.where("owner % 25 <> 1").withColumn("n", F.col("n") + F.when(F.col("owner") % 40 == 0, 1).otherwise(0))
    return differences(stored, live)


