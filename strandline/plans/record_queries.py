"""Queries over records with parts, devices, filters, retention and laboratory results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import labs, records
from strandline.plans.registry import query
from strandline.sources.tables import measurements, table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with a life: some replaced, some deleted, some components of a group."""
    m = measurements(spark, sf_dir)
    s = F.unix_micros("start_at")
    return m.select("id", "owner", F.col("source").alias("metric"), "value", s.alias("at"), F.unix_micros("end_at").alias("until"), F.when(F.col("id") % 6 == 1, s + 1).alias("superseded_at"), F.when(F.col("id") % 9 == 2, s + 2).alias("deleted_at"), F.when(F.col("id") % 6 == 1, F.col("id") + 1).alias("superseded_by"), F.expr("id div 4").alias("group_id"), (F.col("id") % 5).alias("device_id"))


_ROWS = """, r AS (SELECT id, owner, source AS metric, value, s AS "at", e AS until, CASE WHEN id % 6 = 1 THEN s + 1 END AS superseded_at, CASE WHEN id % 9 = 2 THEN s + 2 END AS deleted_at, CASE WHEN id % 6 = 1 THEN id + 1 END AS superseded_by, id // 4 AS group_id, id % 5 AS device_id FROM m)"""


@query("sc2_range_scan", _ROWS + ' SELECT id, metric, "at" FROM r WHERE superseded_at IS NULL AND deleted_at IS NULL AND metric IN (\'view\', \'error\') AND "at" >= 1704500000000000 AND "at" < 1705500000000000')
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.range_scan(rows(spark, sf_dir), ["view", "error"], F.lit(1_704_500_000_000_000), F.lit(1_705_500_000_000_000), "at").select("id", "metric", "at")


@query("sc3_sc7_read_page", _ROWS + """, q AS (SELECT * FROM r WHERE metric IN ('view', 'click') AND deleted_at IS NULL AND ("at" > 1704800000000000 OR ("at" = 1704800000000000 AND id > 3)) ORDER BY "at", id LIMIT 41), n AS (SELECT *, row_number() OVER (ORDER BY "at", id) AS i, count(*) OVER () > 40 AS has_more FROM q)
SELECT id, "at", has_more, CASE WHEN has_more AND i = 40 THEN to_base64(encode(CAST("at" AS VARCHAR) || '|' || CAST(id AS VARCHAR))) END AS cursor FROM n WHERE i <= 40""")
def read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what was ever written of two metrics, replaced rows included, with the key to go on from."""
    got = records.read(rows(spark, sf_dir), "at", size=40, after=(1_704_800_000_000_000, 3), superseded=True, metric=["view", "click"])
    return records.page(got, "at", "id", 40).select("id", "at", "has_more", "cursor")


@query("sc4_groups", _ROWS + """, o AS (SELECT a.id FROM r a JOIN r b ON b.id = a.superseded_by AND b.group_id = a.group_id), l AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM o) QUALIFY row_number() OVER (PARTITION BY group_id, metric ORDER BY id DESC) = 1)
SELECT group_id AS id, count(*) AS components, round(sum(value), 6) AS total FROM l GROUP BY group_id""")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with the last version of each component that points at them."""
    r = rows(spark, sf_dir)
    got = records.with_components(r.select(F.col("group_id").alias("id")).distinct(), r)
    return got.select("id", F.size("components").cast("long").alias("components"), F.round(F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("sc5_sc6_children", """SELECT o_orderkey AS id, coalesce(n, 0) AS segments, coalesce(qty, 0) AS quantity, first FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, min_by(l_partkey, (l_linenumber, l_partkey)) AS first FROM lineitem WHERE l_linenumber < 5 AND l_orderkey % 3 <> 0 GROUP BY ALL) ON l_orderkey = o_orderkey""", events=False)
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").where("l_linenumber < 5 and l_orderkey % 3 <> 0").select("l_orderkey", F.col("l_linenumber").alias("seq"), "l_partkey", "l_quantity")
    got = records.with_children(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), parts, "l_orderkey", ["seq"], "segments")
    return got.select("id", F.size("segments").cast("long").alias("segments"), F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"), F.get("segments", F.lit(0))["l_partkey"].alias("first"))


@query("wr3_event_upserts", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 1 THEN 'keep' WHEN o_orderkey % 10 = 2 THEN 'insert' WHEN o_orderkey % 10 = 3 THEN 'supersede' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_quantity > 30) THEN 'supersede' ELSE 'unchanged' END AS action FROM orders""", events=False)
def event_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose parts come in another order are unchanged; one part that differs makes a new version."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    parts = table(spark, sf_dir, "lineitem")
    held = lambda q: parts.groupBy(F.col("l_orderkey").alias("_k")).agg(F.collect_list(F.struct("l_linenumber", q.alias("q"))).alias("stages"))
    none = F.array().cast("array<struct<l_linenumber:int,q:double>>")
    whole = lambda df, h: df.join(h, F.col("key") == F.col("_k"), "left").select("key", "status", F.coalesce(F.col("stages").cast("array<struct<l_linenumber:int,q:double>>"), none).alias("stages"))
    stored = whole(o.where("key % 10 <> 2"), held(F.col("l_quantity")))
    new = F.when((F.col("l_linenumber") == 2) & (F.col("l_quantity") > 30), 0.5).otherwise(F.col("l_quantity"))
    incoming = whole(o.where("key % 10 <> 1").withColumn("status", F.when(F.col("key") % 10 == 3, "?").otherwise(F.col("status"))), held(new)).withColumn("stages", F.reverse("stages"))
    return records.upsert_events(stored, incoming, "key", ["status"], "stages")


@query("wr5_group_cascade", _ROWS + " SELECT id, group_id % 7 = 0 AS deleted FROM r")
def group_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    g = r.select(F.col("group_id").alias("id")).distinct().withColumn("external_id", F.concat(F.lit("g"), F.col("id").cast("string")))
    return records.cascade(g, r, g.where("id % 7 = 0").select("external_id"))[1].select("id", "deleted")


@query("wr10_devices", """WITH s AS (SELECT l_suppkey AS fingerprint, max_by(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) FILTER (l_linenumber > 3) AS dt, max_by(l_linestatus, (l_orderkey, l_linenumber, l_linestatus)) AS mf FROM lineitem GROUP BY ALL)
SELECT s_suppkey AS fingerprint, CASE WHEN s_suppkey % 3 = 0 THEN 'mine' ELSE coalesce(dt, 'old') END AS device_type, s_suppkey % 3 = 0 AS by_owner, coalesce(mf, 'none') AS manufacturer FROM supplier LEFT JOIN s ON fingerprint = s_suppkey""", events=False)
def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sighting fills what it knows, what it doesn't know stays, and a type that the owner set wins."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("fingerprint"), F.when(F.col("s_suppkey") % 3 == 0, "mine").otherwise("old").alias("device_type"), (F.col("s_suppkey") % 3 == 0).alias("by_owner"), F.lit("none").alias("manufacturer"), F.lit(None).cast("string").alias("model"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("fingerprint"), F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("device_type"), F.col("l_linestatus").alias("manufacturer"), F.lit(None).cast("string").alias("model"), F.struct("l_orderkey", "l_linenumber").alias("seen_at"))
    return records.upsert_devices(known, seen, "seen_at").select("fingerprint", "device_type", "by_owner", "manufacturer")


@query("wr10_relayed_origins", """SELECT p_partkey, CASE WHEN p_name LIKE 'Part#1%' THEN 'one' WHEN p_name LIKE '%7' THEN 'seven' WHEN p_name LIKE 'Part#%' AND p_size > 25 THEN 'large' END AS relay FROM part""", events=False)
def relayed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(2, "x", "%7", "seven"), (1, "x", "Part#1%", "one"), (1, "y", "Part#1%", "one"), (2, "y", "%7", "seven"), (3, "y", "Part#%", "large")], "id int, provider string, pattern string, target string")
    o = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "y").otherwise("x").alias("provider"), F.col("p_name").alias("origin_key"))
    return records.relayed_by(o, known).select("p_partkey", "relay")


@query("wr11_device_merge", """, d AS (SELECT unnest(range(5)) AS id), f AS (SELECT id, CASE id WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 2 END AS merged_into FROM d)
SELECT coalesce(f.merged_into, f.id) AS device_id, count(*) AS n FROM m JOIN f ON f.id = m.id % 5 GROUP BY ALL""")
def device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 was merged into 0 before; now 0 goes into 2, and 3 too: everything points at 2."""
    d = spark.createDataFrame([(0, None), (1, 0), (2, None), (3, None), (4, None)], "id long, merged_into long")
    merged = records.merge_devices(d, spark.createDataFrame([(0, 2), (3, 2)], "id long, target long"))
    return records.moved(rows(spark, sf_dir), merged).groupBy("device_id").agg(F.count("*").alias("n"))


@query("ag26_device_records", _ROWS + " SELECT device_id, 'measurements' AS kind, count(*) AS n FROM r WHERE superseded_at IS NULL AND deleted_at IS NULL GROUP BY ALL UNION ALL SELECT device_id, 'groups', count(*) FROM r WHERE id % 4 = 0 GROUP BY ALL UNION ALL SELECT device_id, 'workouts', count(*) FROM r WHERE metric = 'purchase' GROUP BY ALL")
def device_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return records.device_records({"measurements": records.active(r), "groups": r.where("id % 4 = 0"), "workouts": r.where("metric = 'purchase'")})


@query("sc21_workout_routes", """, w AS (SELECT id, 'x' || CAST(id AS VARCHAR) AS external_id, owner AS connection, CASE WHEN id % 2 = 0 THEN k END AS origin, s AS lo, e AS hi FROM m WHERE source = 'purchase' AND e > s),
v AS (SELECT id AS event, CASE WHEN id % 5 = 0 THEN 'x' || CAST(id + 1 AS VARCHAR) END AS workout, owner AS connection, CASE WHEN id % 2 = 0 THEN k END AS origin, s AS t FROM m WHERE source <> 'signup'),
c AS (SELECT w.id, 0 AS r, t, event FROM w JOIN v ON v.workout = w.external_id AND t >= lo - 86400000000 AND t < hi + 86400000000 UNION ALL SELECT w.id, 1, t, event FROM w JOIN v ON v.workout IS NULL AND v.connection = w.connection AND v.origin IS NOT DISTINCT FROM w.origin AND t >= lo AND t < hi)
SELECT w.id, min_by(event, (r, t, event)) AS route FROM w LEFT JOIN c USING (id) GROUP BY w.id""")
def workout_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    origin = F.when(F.col("id") % 2 == 0, F.col("k"))
    text = lambda c: F.concat(F.lit("x"), c.cast("string"))
    w = m.where("source = 'purchase' and end_at > start_at").select("id", text(F.col("id")).alias("external_id"), F.col("owner").alias("connection"), origin.alias("origin"), F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"))
    v = m.where("source <> 'signup'").select(F.col("id").alias("event"), F.when(F.col("id") % 5 == 0, text(F.col("id") + 1)).alias("workout"), F.col("owner").alias("connection"), origin.alias("origin"), F.unix_micros("start_at").alias("at"))
    return records.routes(w, v)


CHOICES = ((1, "click", None, False), (1, "click", "late", True), (2, "app", None, False), (3, "error", None, True))
_DECIDED = """, o AS (SELECT *, CASE WHEN k >= 50 THEN 'late' ELSE 'early' END AS kind, CASE WHEN source IN ('view', 'purchase') THEN 'app' END AS parent FROM m),
f AS (SELECT *, CASE WHEN owner = 1 AND source = 'click' THEN kind = 'late' WHEN owner = 3 AND source = 'error' THEN true WHEN owner = 2 AND parent = 'app' THEN false WHEN source LIKE 'err%' THEN false ELSE true END AS take FROM o)"""


def _decided(spark: SparkSession, sf_dir: str, choices: tuple = CHOICES) -> tuple[DataFrame, DataFrame]:
    m = measurements(spark, sf_dir).withColumn("kind", F.when(F.col("k") >= 50, "late").otherwise("early")).withColumnRenamed("source", "origin")
    origins = m.select("owner", "origin", "kind").distinct().withColumn("parent", F.when(F.col("origin").isin("view", "purchase"), "app"))
    c = spark.createDataFrame(list(choices), "owner long, origin string, kind string, take boolean")
    return m, records.filter_decision(c, origins, spark.createDataFrame([("err%",)], "pattern string"))


@query("nz15_nz16_filter_operator", _DECIDED + " SELECT owner, source AS origin, kind, count(*) AS ignored, min(s) AS first_at, max(s) AS last_at FROM f WHERE NOT take GROUP BY ALL")
def filter_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner's choice, for one kind or all, then that of the parent app, then the default patterns."""
    m, d = _decided(spark, sf_dir)
    held = m.join(d.select("owner", "origin", "kind", "take"), ["owner", "origin", "kind"])
    return records.ignored(held.withColumn("at", F.unix_micros("start_at")), ["owner", "origin", "kind"], "at")


@query("nz17_filter_changes", _DECIDED + """, g AS (SELECT DISTINCT owner, source, kind, take, CASE WHEN source LIKE 'err%' THEN false ELSE true END AS old FROM f) SELECT owner, source AS origin, kind, CASE WHEN take THEN 'fetch_again' ELSE 'drop' END AS change FROM g WHERE take <> old""")
def filter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, before = _decided(spark, sf_dir, ((-1, "none", None, True),))
    return records.filter_changes(before, _decided(spark, sf_dir)[1])


@query("wr7_writer_flags", """SELECT flags | CASE WHEN value NOT BETWEEN 1 AND 180 THEN 4 ELSE 0 END | CASE WHEN source = 'error' THEN 8 ELSE 0 END AS flags, count(*) AS n FROM m GROUP BY ALL""")
def writer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = records.writer_flags(F.col("flags"), F.col("value"), F.lit(1.0), F.lit(180.0), F.col("source") == "error")
    return measurements(spark, sf_dir).groupBy(f.alias("flags")).agg(F.count("*").alias("n"))


@query("sr12_prunable_tail", """, c AS (SELECT id, s, lead(id) OVER w AS nx, lead(s) OVER w AS sup, lag(id) OVER w AS pv FROM m WINDOW w AS (PARTITION BY owner, source, d ORDER BY s, id)) SELECT id FROM c WHERE nx IS NOT NULL AND sup < 1705600000000000 AND pv IS NULL""")
def prunable_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("owner", "source", "local_date").orderBy("start_at", "id")
    v = measurements(spark, sf_dir).withColumn("superseded_by", F.lead("id").over(w)).withColumn("superseded_at", F.lead(F.unix_micros("start_at")).over(w))
    return records.prunable_tail(v, F.lit(1_705_600_000_000_000)).select("id")


@query("sr12_prunable_raw", """, p AS (SELECT id, s, lag(id) OVER (PARTITION BY owner ORDER BY id) AS supersedes FROM m), q AS (SELECT p.id FROM p WHERE supersedes IS NULL AND s < 1706000000000000 AND id IN (SELECT supersedes FROM p)) SELECT id AS raw_id FROM q WHERE id % 6 = 1 OR id % 9 = 2""")
def prunable_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    raw = measurements(spark, sf_dir).select(F.col("id").alias("raw_id"), F.unix_micros("start_at").alias("stored_at"), F.lag("id").over(Window.partitionBy("owner").orderBy("id")).alias("supersedes"))
    return records.prunable_raw(raw, rows(spark, sf_dir).withColumn("raw_id", F.col("id")), F.lit(1_706_000_000_000_000)).select("raw_id")


# ---- laboratory


@query("lb2_suggested_analytes", """WITH a AS (SELECT n_nationkey, lower(trim(n_name)) AS label_key FROM nation) SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'mine' ELSE 'shared' || CAST(a.n_nationkey AS VARCHAR) END AS code FROM supplier JOIN a ON a.n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL END FROM supplier WHERE s_suppkey % 5 = 0""", events=False)
def suggested_analytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's own alias beats the shared one; owners are told apart, and an unknown label has none."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    shared = n.select(F.lit(None).cast("long").alias("owner"), F.lower(F.trim("n_name")).alias("label_key"), F.concat(F.lit("shared"), F.col("n_nationkey").cast("string")).alias("code"))
    own = n.select(F.lit(0).cast("long").alias("owner"), F.lower(F.trim("n_name")).alias("label_key"), F.lit("mine").alias("code"))
    labels = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (F.col("s_suppkey") % 4).cast("long").alias("owner"), F.when(F.col("s_suppkey") % 5 == 0, "nothing known").otherwise(F.concat(F.lit("  "), F.upper("n_name"))).alias("label"))
    return labs.suggest(labels, shared.union(own)).select("s_suppkey", "code")


@query("lb4_confirmed_results", """, x AS (SELECT id, owner, source AS code, d, value, CASE WHEN id % 3 = 0 THEN 18.0 ELSE 1.0 END AS factor FROM m), f AS (SELECT owner, code, d, min(id) AS id FROM x GROUP BY ALL)
SELECT x.id, round(x.value / factor, 6) AS result, factor, CAST(CASE WHEN x.id % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS revision, x.id % 10 <> 0 AS active FROM x JOIN f USING (id)""")
def confirmed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows confirmed to results once each, with the factor that was used; taking one back adds a revision and keeps the row."""
    m = measurements(spark, sf_dir).select("id", "owner", F.col("source").alias("code"), F.col("local_date").alias("date"), "value", F.when(F.col("id") % 3 == 0, 18.0).otherwise(1.0).alias("factor"))
    done = labs.confirm(m, ["owner", "code", "date"])
    return labs.unconfirm(done, m.where("id % 10 = 0").select("id")).select("id", F.round("result", 6).alias("result"), "factor", "revision", "active")


@query("lb5_ag25_lab_inventory", """, x AS (SELECT id, source AS code, d, value FROM m WHERE id % 10 <> 0) SELECT code, count(*) AS n, min(d) AS first, max(d) AS last, max_by(value, (d, id)) AS latest, count(DISTINCT d) AS days FROM x GROUP BY code ORDER BY last DESC NULLS LAST, code""")
def lab_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).where("id % 10 <> 0").select("id", F.col("source").alias("code"), F.col("local_date").alias("date"), F.col("value").alias("result"))
    return labs.inventory(m)


@query("ig5_request_outcomes", """, r AS (SELECT id, CASE WHEN id % 10 <> 0 THEN CAST(owner AS VARCHAR) || '-' || CAST(k % 20 AS VARCHAR) END AS key, source FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS i, first(source) OVER (PARTITION BY key ORDER BY id) AS f FROM r)
SELECT id, CASE WHEN key IS NULL OR i = 1 THEN 'stored' WHEN source = f THEN 'replay' ELSE 'conflict' END AS outcome FROM n""")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under an idempotency key: the first is stored, the same again answered, another refused."""
    m = measurements(spark, sf_dir)
    key = F.when(F.col("id") % 10 != 0, F.concat_ws("-", F.col("owner").cast("string"), (F.col("k") % 20).cast("string")))
    return records.requests(m.select("id", key.alias("key"), F.sha2("source", 256).alias("digest")), "key", "digest", "id").select("id", "outcome")


@query("ig5_silent_clients", """SELECT owner, source, max(s) AS last_at, max(s) < 1706400000000000 - 86400000000 AS silent FROM m GROUP BY ALL""")
def silent_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("s", F.unix_micros("start_at"))
    return records.silent(m, ["owner", "source"], "s", F.lit(1_706_400_000_000_000), 86_400_000_000)
