"""WARC records, and not-modified revisits resolved against the latest earlier full response.

A revisit says that a page hadn't changed and holds no body.  It is answered by an as-of join: of the
records with the same canonical URL, the latest full response before it, if their validators agree;
headers that a not-modified answer may update are merged into the stored ones.

The join is skew-safe: records of a URL are cut into buckets of time, the last response of each bucket
is carried to the later ones, and only records of one bucket of one URL meet in a window.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Seconds in a bucket of time.
BUCKET = 3_600
# Headers of the stored response that a not-modified answer never replaces.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that don't change a page.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|sessionid)(=|$)"

_URL = r"^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?(\[[^\]/?#]*\]|[^/?#:\[]*)(:[0-9]+)?([^?#]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, ``www.`` and the usual port of the scheme; path without a last slash; other parameters in order; no fragment.

    A URL without a host is its own canonical form, without spaces around it.
    """
    part = lambda i: F.regexp_extract(url, _URL, i)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    path = F.regexp_replace(F.trim(part(4)), "/+$", "")
    usual = F.concat(F.lower(part(1)), part(3)).isin("http:80", "https:443")
    whole = F.concat(F.lower(part(2)), F.when(usual, "").otherwise(part(3)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.isNotNull(), F.when(part(2) == "", F.trim(url)).otherwise(whole))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET, name: str = "warc") -> DataFrame:
    """Each revisit of ``records`` with ``state``, ``refers_to``, ``refers_ts``, ``body_digest`` and merged ``headers``.

    ``records``: record_id long, url string, ts long (seconds), kind ("response" or "revisit"), status
    int, etag, last_modified, digest strings, headers map<string,string> with lower-case names.  Of
    records at one time the smaller id is earlier.  Responses count if their status is 200.  States:
    ``resolved``; ``mismatch`` (the first validator that the revisit has - entity tag, then date, then
    digest - differs from the response's); ``unvalidated`` (it has none: nothing is merged);
    ``missing`` (no earlier full response, or no URL).  Rows without id or time are left out; repeated
    rows are resolved alike, each to an earlier record.  Values of any length are compared whole; an
    empty table gives an empty one; other columns are left out, whatever their names.
    """
    scratch = Scratch(records.sparkSession, name)
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    answer = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    taken = ("record_id", "url", "ts", "kind", "status", "etag", "last_modified", "digest", "headers")
    rows = records.where("record_id is not null and ts is not null").select(*taken, canonical_url(F.col("url")).alias("key"))
    known = rows.where("key is not null").withColumn("b", F.expr(f"ts div {bucket}")).withColumn("full", F.when(full, answer))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ends = known.where("full is not null").groupBy("key", "b").agg(F.max_by("full", F.struct("ts", "record_id")).alias("end"))
    # every bucket with records, so that the last response before it can be looked up
    ends = known.select("key", "b").distinct().join(scratch.save(ends), ["key", "b"], "left")
    carried = scratch.save(ends.select("key", "b", F.last("end", ignorenulls=True).over(before("key").orderBy("b")).alias("carried")).where("carried is not null"))
    near = known.withColumn("near", F.last("full", ignorenulls=True).over(before("key", "b").orderBy("ts", "record_id"))).where("kind = 'revisit'")
    found = near.join(carried, ["key", "b"], "left").withColumn("r", F.coalesce("near", "carried"))
    lost = rows.where("key is null and kind = 'revisit'").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    columns = ["record_id", "url", "key", "ts", "etag", "last_modified", "digest", "headers", "r"]
    found = found.select(*columns).union(lost.select(*columns))
    same = F.coalesce(_strong(F.col("etag")) == _strong(F.col("r.etag")), F.lit(False))
    state = (
        F.when(F.col("r").isNull(), "missing")
        .when(F.col("etag").isNotNull(), F.when(same, "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified").eqNullSafe(F.col("r.last_modified")), "resolved").otherwise("mismatch"))
        .when(F.col("digest").isNotNull(), F.when(F.col("digest").eqNullSafe(F.col("r.digest")), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: ~k.isin(*KEPT))
    stored = F.map_filter(F.coalesce("r.headers", none), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    resolved = F.col("state") == "resolved"
    return found.withColumn("state", state).select(
        "record_id", "url", F.col("key").alias("canonical_url"), "ts", "state",
        F.when(resolved, F.col("r.record_id")).alias("refers_to"), F.when(resolved, F.col("r.ts")).alias("refers_ts"),
        F.when(resolved, F.col("r.digest")).alias("body_digest"), F.when(resolved, F.map_concat(stored, fresh)).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers in order of their names, as one string."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def captures(pages: DataFrame) -> DataFrame:
    """Raw pages as capture records: one a minute in order of page_id, each third one a revisit, with validators that change now and then."""
    revisit = F.col("page_id") % 3 == 1
    etag = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('"v'), (F.col("page_id") % 2).cast("string"), F.lit('"')))
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.coalesce(F.length("html"), F.lit(0))), F.lit("cache-control"), F.concat(F.lit("max-age="), text(F.col("page_id") % 100)), F.lit("x-capture"), text(F.col("page_id")))
    fresh = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), text(F.col("page_id") % 100)), F.lit("date"), text(F.col("page_id") * 60))
    return pages.select(
        F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 60).alias("ts"), F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, 304).otherwise(200).alias("status"), etag.alias("etag"), F.when(F.col("page_id") % 7 != 0, text(F.col("page_id") % 2)).alias("last_modified"),
        F.when(~revisit, F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest"), F.when(revisit, fresh).otherwise(stored).alias("headers"),
    )


# The query over captures(pages) in DuckDB's SQL.
ORACLE = rf"""
WITH c AS (
  SELECT page_id, url, html, page_id * 60 AS ts, page_id % 3 = 1 AS revisit,
    CASE WHEN page_id % 5 <> 0 THEN '"v' || (page_id % 2)::VARCHAR || '"' END AS etag,
    CASE WHEN page_id % 7 <> 0 THEN (page_id % 2)::VARCHAR END AS lm,
    lower(regexp_extract(url, '{_URL}', 1)) AS scheme, regexp_extract(url, '{_URL}', 2) AS host, regexp_extract(url, '{_URL}', 3) AS port, trim(regexp_extract(url, '{_URL}', 4), ' ') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS q
  FROM pages),
k AS (SELECT *, CASE WHEN host = '' THEN trim(url, ' ') ELSE lower(host) || CASE WHEN scheme || port IN ('http:80', 'https:443') THEN '' ELSE port END || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM c),
r AS (SELECT k.*, (SELECT max(o.page_id) FROM k o WHERE o.key = k.key AND NOT o.revisit AND o.page_id < k.page_id) AS ref FROM k WHERE revisit),
s AS (
  SELECT r.*, o.html AS body, o.page_id AS oid, CASE WHEN ref IS NULL THEN 'missing'
      WHEN r.etag IS NOT NULL THEN CASE WHEN r.etag = o.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN r.lm IS NOT NULL THEN CASE WHEN r.lm = o.lm THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unvalidated' END AS state
  FROM r LEFT JOIN k o ON o.page_id = r.ref)
SELECT page_id AS record_id, key AS canonical_url, ts, state,
  CASE WHEN state = 'resolved' THEN oid END AS refers_to, CASE WHEN state = 'resolved' THEN oid * 60 END AS refers_ts,
  CASE WHEN state = 'resolved' THEN sha256(coalesce(body, '')) END AS body_digest,
  CASE WHEN state = 'resolved' THEN 'cache-control=max-age=' || (page_id % 100)::VARCHAR || ';content-length=' || coalesce(length(body), 0)::VARCHAR
    || ';content-type=text/html;date=' || (page_id * 60)::VARCHAR || ';x-capture=' || oid::VARCHAR END AS headers
FROM s
"""


def parse_warc(data: bytes | BinaryIO) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped by record, one after the other as the file is read; a damaged tail ends it."""
    plain = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    with io.BufferedReader(gzip.GzipFile(fileobj=plain)) if plain.peek(2)[:2] == b"\x1f\x8b" else plain as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = _headers(f)
            size = int(head.get("content-length", "0") or 0)
            body = f.read(size)
            if len(body) < size:
                return
            out = {"record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": head.get("warc-payload-digest"), "status": None, "headers": {}, "body": body}
            if "msgtype=response" in head.get("content-type", "").replace(" ", "").lower() or body[:5] == b"HTTP/":
                http = io.BytesIO(body)
                words = http.readline().split()
                out["status"] = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
                out["headers"] = _headers(http)
                out["body"] = http.read()
            yield out


def _headers(f) -> dict[str, str]:
    """Headers by their name in lower case; values of a repeated name stand one after the other, as in HTTP."""
    out: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


_TYPE = "record_id string, kind string, url string, date string, digest string, status int, headers map<string,string>, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, a file a task; a file is read as a stream, so that only one record at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "kind", "url", "date", "digest", "status", "headers", "body"]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri))
                with store.open_input_stream(inner, compression=None) as stream:
                    for r in parse_warc(stream):
                        yield pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

    # the content column isn't read: pruned, so that no file has to fit a row
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, _TYPE)


def records_of(warc: DataFrame) -> DataFrame:
    """Parsed records in the form that ``resolve_revisits`` takes, numbered by a hash of their id."""
    h = F.col("headers")
    return warc.where("kind in ('response', 'revisit')").select(
        F.xxhash64("record_id").alias("record_id"), "url", F.unix_seconds(F.try_to_timestamp("date")).alias("ts"), "kind", "status",
        h["etag"].alias("etag"), h["last-modified"].alias("last_modified"), "digest", "headers",
    )
