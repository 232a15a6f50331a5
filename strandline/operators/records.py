"""Records with parts: groups, sessions, workouts and events read, written, merged and moved between devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    """Rows that nothing has replaced or deleted."""
    return df.where("superseded_at is null and deleted_at is null")


def range_scan(df: DataFrame, metrics: list[str], lo: Column, hi: Column, at: str = "start_at", id_col: str = "id", metric: str = "metric") -> DataFrame:
    """Active rows of some metrics that start in [lo, hi), in total order."""
    return active(df).where(F.col(metric).isin(metrics)).where((F.col(at) >= lo) & (F.col(at) < hi)).orderBy(at, id_col)


def read(df: DataFrame, at: str, id_col: str = "id", size: int | None = None, after: tuple | None = None, superseded: bool = False, deleted: bool = False, **equal) -> DataFrame:
    """Rows by optional filters (a list means any of it), replaced and deleted ones only when asked for, after a key and up to one more than a page."""
    for column, want in equal.items():
        if want is not None:
            df = df.where(F.col(column).isin(want) if isinstance(want, (list, tuple)) else F.col(column) == F.lit(want))
    if not superseded:
        df = df.where("superseded_at is null")
    if not deleted:
        df = df.where("deleted_at is null")
    if after is not None:
        df = df.where((F.col(at) > F.lit(after[0])) | ((F.col(at) == F.lit(after[0])) & (F.col(id_col) > F.lit(after[1]))))
    return df if size is None else df.orderBy(at, id_col).limit(size + 1)


def page(rows: DataFrame, at: str, id_col: str, size: int) -> DataFrame:
    """The page itself with ``has_more``, whether a row came beyond it, and ``cursor``, the key to go on from."""
    n = F.row_number().over(Window.orderBy(at, id_col))  # a page and one row
    more = rows.withColumn("_n", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("_n") <= size)
    return more.withColumn("cursor", F.when(F.col("has_more") & (F.col("_n") == size), F.base64(F.concat_ws("|", F.col(at).cast("string"), F.col(id_col).cast("string")).cast("binary")))).drop("_n")


def with_components(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``groups(id)`` with ``components``: of every component the last version that points at the group."""
    newer = rows.select(F.col("id").alias("superseded_by"), F.col("group_id").alias("_g"))
    older = rows.join(newer, "superseded_by").where("group_id = _g").select("id")
    last = rows.join(older, "id", "left_anti").groupBy("group_id", "metric").agg(F.max_by("value", "id").alias("value"))
    parts = last.groupBy(F.col("group_id").alias("_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("components"))
    return groups.join(parts, F.col("id") == F.col("_id"), "left").drop("_id")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``parents(id)`` with their ``children(key, ...)`` as an array in order; empty where there are none."""
    rest = [c for c in children.columns if c not in (key, *order)]
    held = children.groupBy(F.col(key).alias("_id")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    kind = held.schema[name].dataType
    return parents.join(held, F.col("id") == F.col("_id"), "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).drop("_id")


def upsert_events(stored: DataFrame, incoming: DataFrame, key: str, content: list[str], children: str) -> DataFrame:
    """``(key, action)``: as for rows, where a record also differs if any of its parts does, in whatever order they come."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*content, F.array_sort(children).alias("_c")).alias(name), F.lit(True).alias(f"{name}is"))

    out = side(stored, "_a").join(side(incoming, "_b"), key, "full")
    action = F.when(F.col("_bis").isNull(), "keep").when(F.col("_ais").isNull(), "insert").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("supersede")
    return out.select(key, action.alias("action"))


def cascade(groups: DataFrame, rows: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``groups`` and ``rows`` with ``deleted``: a group that is named takes its components with it."""
    gone = deleted.select(F.col("external_id").alias("_x")).distinct().withColumn("_gone", F.lit(True))
    g = groups.join(gone, F.col("external_id") == F.col("_x"), "left").withColumn("deleted", F.col("_gone").isNotNull()).drop("_x", "_gone")
    r = rows.join(g.where("deleted").select(F.col("id").alias("_g")), F.col("group_id") == F.col("_g"), "left").withColumn("deleted", F.col("_g").isNotNull()).drop("_g")
    return g, r


def upsert_devices(known: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """``(fingerprint, device_type, by_owner, manufacturer, model)``: each sighting fills what it knows, a type set by the owner stays."""
    columns = ["device_type", "manufacturer", "model"]
    last = seen.groupBy("fingerprint").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_{c}") for c in columns])
    out = known.join(last, "fingerprint", "full")
    kind = F.when(F.coalesce("by_owner", F.lit(False)), F.col("device_type")).otherwise(F.coalesce("_device_type", "device_type"))
    return out.select("fingerprint", kind.alias("device_type"), F.coalesce("by_owner", F.lit(False)).alias("by_owner"), F.coalesce("_manufacturer", "manufacturer").alias("manufacturer"), F.coalesce("_model", "model").alias("model"))


def relayed_by(origins: DataFrame, known: DataFrame) -> DataFrame:
    """``origins(provider, origin_key)`` with ``relay``: the target of the first known pattern (``provider, pattern, target, id``) that a key matches."""
    p = known.select("provider", "pattern", "target", F.col("id").alias("_i"))
    met = origins.join(p, "provider").where(F.expr("origin_key like pattern"))
    first = met.groupBy("provider", "origin_key").agg(F.min_by("target", "_i").alias("relay"))
    return origins.join(first, ["provider", "origin_key"], "left")


def merge_devices(devices: DataFrame, merges: DataFrame) -> DataFrame:
    """``devices(id, merged_into)`` after ``merges(id, target)``: a device and all that were merged into it point at the target, never a chain."""
    m = merges.select(F.col("id").alias("_m"), "target")
    root = F.coalesce("merged_into", "id")
    out = devices.join(m, root == F.col("_m"), "left")
    return out.select("id", F.when(F.coalesce("target", "merged_into") != F.col("id"), F.coalesce("target", "merged_into")).alias("merged_into"))


def moved(rows: DataFrame, devices: DataFrame, device: str = "device_id") -> DataFrame:
    """``rows`` on the device that theirs was merged into; replaced and deleted rows move too."""
    to = devices.where("merged_into is not null").select(F.col("id").alias(device), F.col("merged_into").alias("_to"))
    return rows.join(to, device, "left").withColumn(device, F.coalesce("_to", device)).drop("_to")


def device_records(parts: dict[str, DataFrame]) -> DataFrame:
    """``(device_id, kind, n)`` over the tables of each kind."""
    out = None
    for kind, df in parts.items():
        one = df.where("device_id is not null").groupBy("device_id").agg(F.count("*").alias("n")).select("device_id", F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


def routes(workouts: DataFrame, events: DataFrame, day: int = 86_400_000_000) -> DataFrame:
    """``(id, route)``: for each workout the event that names it, else the first one without a name inside it, of the same connection and origin.

    ``workouts(id, external_id, connection, origin, lo, hi)``, ``events(event, workout, connection, origin, at)``.
    """
    w, e = workouts.withColumnRenamed("connection", "_wc").withColumnRenamed("origin", "_wo"), events
    named = w.join(e.where("workout is not null"), F.col("external_id") == F.col("workout")).where((F.col("at") >= F.col("lo") - day) & (F.col("at") < F.col("hi") + day)).select("id", F.lit(0).alias("_r"), "at", "event")
    cells = w.withColumn("_cell", F.explode(F.sequence(F.expr(f"lo div {day}"), F.expr(f"(hi - 1) div {day}"))))
    loose = e.where("workout is null").withColumn("_cell", F.expr(f"at div {day}"))
    inside = cells.join(loose, "_cell").where((F.col("connection") == F.col("_wc")) & F.col("origin").eqNullSafe(F.col("_wo")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("id", F.lit(1).alias("_r"), "at", "event")
    best = named.union(inside).groupBy("id").agg(F.min_by("event", F.struct("_r", "at", "event")).alias("route"))
    return workouts.join(best, "id", "left").select("id", "route")


def filter_decision(choices: DataFrame, origins: DataFrame, patterns: DataFrame) -> DataFrame:
    """``origins(owner, origin, parent, kind)`` with ``take``: the owner's choice for it, else for its parent app, else what a default pattern says, else yes.

    ``choices(owner, origin, kind, take)`` hold a null kind where they go for every kind; ``patterns(pattern)`` are not taken by default.
    """
    c = choices.select("owner", F.col("origin").alias("_o"), F.col("kind").alias("_k"), F.col("take").alias("_t"))
    out = origins
    for n, column in (("_own", "origin"), ("_parent", "parent")):
        met = origins.select("owner", "origin", "kind", column).join(c.withColumnRenamed("owner", "_w"), (F.col("_w") == F.col("owner")) & (F.col("_o") == F.col(column)) & (F.col("_k").isNull() | (F.col("_k") == F.col("kind"))))
        best = met.groupBy("owner", "origin", "kind").agg(F.max_by("_t", F.col("_k").isNotNull()).alias(n))
        out = out.join(best, ["owner", "origin", "kind"], "left")
    no = origins.select("origin").distinct().join(patterns, F.expr("origin like pattern")).select("origin").distinct().withColumn("_no", F.lit(False))
    return out.join(no, "origin", "left").withColumn("take", F.coalesce("_own", "_parent", "_no", F.lit(True))).drop("_own", "_parent", "_no")


def filter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a new filter starts or stops to take: origins that are to be fetched again, or whose rows go."""
    a, b = before.select("owner", "origin", "kind", F.col("take").alias("_a")), after.select("owner", "origin", "kind", F.col("take").alias("_b"))
    out = a.join(b, ["owner", "origin", "kind"], "full").where(~F.coalesce("_a", F.lit(True)).eqNullSafe(F.coalesce("_b", F.lit(True))))
    return out.select("owner", "origin", "kind", F.when(F.coalesce("_b", F.lit(True)), "fetch_again").otherwise("drop").alias("change"))


def ignored(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """How many rows a filter kept out, and when, by what they are."""
    return rows.where("not take").groupBy(*keys).agg(F.count("*").alias("ignored"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def writer_flags(flags: Column, value: Column, low: Column, high: Column, relayed: Column, implausible: int = 4, relay: int = 8) -> Column:
    """``flags`` with what the writer knows: a value outside the catalogue's range, and a source that passes others' data on."""
    return flags.bitwiseOR(F.when((high > low) & ~value.between(low, high), implausible).otherwise(0)).bitwiseOR(F.when(F.coalesce(relayed, F.lit(False)), relay).otherwise(0))


def prunable_tail(versions: DataFrame, cutoff: Column) -> DataFrame:
    """Replaced rows before a cutoff that no older row points at: the old end of each chain, so that nothing dangles."""
    pointed = versions.where("superseded_by is not null").select(F.col("superseded_by").alias("id")).distinct()
    return versions.where(F.col("superseded_at") < cutoff).join(pointed, "id", "left_anti")


def prunable_raw(raw: DataFrame, rows: DataFrame, cutoff: Column) -> DataFrame:
    """Payloads stored before a cutoff that are the oldest version of their record, have been replaced, and that no active row came from."""
    older = raw.where("supersedes is not null").select(F.col("raw_id").alias("_newer"), F.col("supersedes").alias("raw_id"))
    replaced = older.select("raw_id").distinct()
    return raw.where((F.col("stored_at") < cutoff) & F.col("supersedes").isNull()).join(replaced, "raw_id", "left_semi").join(active(rows).select("raw_id"), "raw_id", "left_anti")


def requests(df: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """``df`` with ``outcome``: the first request of a key is ``stored``, the same body again a ``replay``, another body under the key a ``conflict``; requests without a key are all stored."""
    keyed = df.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(F.struct(order, digest)).alias("_first"))
    told = keyed.join(first, key)
    outcome = F.when(F.col(order) == F.col(f"_first.{order}"), "stored").when(F.col(digest) == F.col(f"_first.{digest}"), "replay").otherwise("conflict")
    return told.withColumn("outcome", outcome).select(*df.columns, "outcome").unionByName(df.where(F.col(key).isNull()).withColumn("outcome", F.lit("stored")))


def silent(heartbeats: DataFrame, keys: list[str], at: str, now: Column, limit: int) -> DataFrame:
    """``(keys, last_at, silent)``: clients whose last sign of life is older than ``limit``."""
    out = heartbeats.groupBy(*keys).agg(F.max(at).alias("last_at"))
    return out.withColumn("silent", F.col("last_at") < now - limit)
