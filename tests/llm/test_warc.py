import gzip
import random

from pyspark.sql import functions as F
from strandline.llm.warc import KEPT, canonical_url, read_warc, records_of, resolve_revisits

SCHEMA = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, r string"


def test_canonical_urls(spark):
    urls = ["HTTP://user@WWW.Ex.org:80/A/b/?utm_source=x&b=2&a=1#top", "https://ex.org/A/b?a=1&b=2", "//ex.org:8080/", "https://ex.org?ref=z", None, "example.org/a", " dns:x ", "http://h:443/", "https://h:443/", "http://[::1]:80/x", "mailto:a@b", ""]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u")).alias("k")).collect()]
    assert got == ["ex.org/A/b?a=1&b=2", "ex.org/A/b?a=1&b=2", "ex.org:8080", "ex.org?ref=z", None, "example.org/a", "dns:x", "h:443", "h", "[::1]/x", "mailto:a@b", ""]


def brute(rows):
    out = []
    for r in rows:
        if r[3] != "revisit" or r[0] is None or r[2] is None:
            continue
        old = [o for o in rows if o[3] == "response" and o[4] == 200 and o[1] is not None and o[1] == r[1] and o[0] is not None and o[2] is not None and (o[2], o[0]) < (r[2], r[0])]
        if not old:
            out.append((r[0], "missing", None, None))
            continue
        o = max(old, key=lambda x: (x[2], x[0]))
        have = [(a, b) for a, b in zip(r[5:8], o[5:8], strict=True) if a is not None]
        state = "unvalidated" if not have else "resolved" if have[0][1] is not None and have[0][0].removeprefix("W/") == have[0][1].removeprefix("W/") else "mismatch"
        merged = {**(o[8] or {}), **{k: v for k, v in (r[8] or {}).items() if k not in KEPT}}
        out.append((r[0], state, o[0] if state == "resolved" else None, merged if state == "resolved" else None))
    return out


def test_equals_a_search_of_all_earlier_records(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        kind = rnd.choice(["response", "revisit"])
        pick = lambda *v: rnd.choice(v)
        url = rnd.choice(["http://hot/"] * 6 + [f"http://h{i % 9}/x", None])
        rows.append((i, url, rnd.randrange(0, 5000), kind, 304 if kind == "revisit" else pick(200, 200, 404), pick('"a"', 'W/"a"', '"b"', None), pick("d1", "d2", None), pick("s1", None), pick({"etag": "n", "content-length": "0", "age": str(i)}, None, {}), "x"))
    rows += [rows[5], (None, "http://hot/", 1, "revisit", 304, None, None, None, None, "x"), (9000, "http://hot/", None, "revisit", 304, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (7, 300, 10**6):
        got = [(r.record_id, r.state, r.refers_to, r.headers) for r in resolve_revisits(df, bucket).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, [(a, b, c, d) for a, b, c, d in got]))
        key = lambda r: (r[0], r[1], r[2], sorted(r[3].items()) if r[3] is not None else None)
        assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, brute(rows))))
    assert resolve_revisits(df.limit(0)).count() == 0
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("key", "b", "full", "near", "carried", "end", "state", "refers_to", "canonical_url")])
    assert resolve_revisits(clash).count() == len(brute(rows))


def test_urls_without_a_host_are_kept_apart(spark):
    rows = [(1, "example.org/a", 1, "response", 200, '"e"', None, None, None, "x"), (2, "example.org/b", 2, "revisit", 304, '"e"', None, None, None, "x"), (3, "example.org/a", 3, "revisit", 304, '"e"', None, None, None, "x")]
    got = {r.record_id: (r.state, r.refers_to) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2: ("missing", None), 3: ("resolved", 1)}


def record(kind, uri, date, http, i):
    body = http.encode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_reading_files_and_resolving(spark, tmp_path):
    one = record("response", "http://a.org/x", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "e"\r\nContent-Length: 4\r\n\r\nbody', 1)
    two = record("revisit", "https://www.a.org/x#y", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: "e"\r\nAge: 7\r\nVary: a\r\nVary: b\r\n\r\n', 2)
    (tmp_path / "a.warc").write_bytes(one + two[:-30])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    assert read_warc(spark, str(tmp_path / "a.warc")).count() == 1
    got = read_warc(spark, str(tmp_path / "b.warc.gz"))
    assert [bytes(r.body) for r in got.collect()] == [b"body", b""]
    r = resolve_revisits(records_of(got)).first()
    assert r.state == "resolved" and r.headers == {"etag": '"e"', "content-length": "4", "age": "7", "vary": "a, b"}
