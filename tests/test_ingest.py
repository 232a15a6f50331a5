"""Checked requests, paged sources and gap sessions as streams."""

import hashlib
import json
import random

from strandline.operators import episodes
from strandline.streaming import ingest, sessions
from strandline.streaming.ingest import Inbox, RawStore


def request(key, items=("a",), sent=1, **more):
    body = {"schema": "ingest.v1", "client": {"kind": "device", "name": "app", "version": "1"}, "stream": "scale.measures", "items": [{"key": k, "sent_at": "2024-01-01T00:00:00Z", "sha256": hashlib.sha256(k.encode()).hexdigest(), "body": k} for k in items]} | more
    return {"key": key, "body": json.dumps(body), "sent": sent}


def test_requests_are_checked_and_keys_hold_over_restarts(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()

    def put(n, *rows):
        (box / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))

    put(0, request("k1", ["a", "b"]), request("k1", ["z"], sent=2), request(None, ["c"]), request(None, ["c"]), request("bad", schema="v9"), {"key": "worse", "body": "{no", "sent": 1})
    inbox = Inbox(spark, "file://" + str(tmp_path / "store"))
    ingest.run_inbox(inbox, str(box), str(tmp_path / "cp")).awaitTermination()
    got = {(r.key, r.outcome): r for r in inbox.table("outcomes").collect()}
    assert set(got) == {("k1", "stored"), ("k1", "conflict"), (None, "stored"), ("bad", "rejected"), ("worse", "rejected")}
    assert [e.pointer for e in got["bad", "rejected"].errors] == ["/schema"] and [e.pointer for e in got["worse", "rejected"].errors] == [""]
    assert sorted(r.item for r in inbox.table("items").collect()) == ["a", "b", "c"]

    # another process, another checkpoint: files that were read come again and change nothing, keys still hold
    put(1, request("k1", ["a", "b"], sent=9), request("k1", ["other"], sent=9), request("bad", ["now right"]))
    again = Inbox(spark, "file://" + str(tmp_path / "store"))
    ingest.run_inbox(again, str(box), str(tmp_path / "new")).awaitTermination()
    assert sorted(r.item for r in again.table("items").collect()) == ["a", "b", "c", "now right"]
    assert sorted(r.outcome for r in again.table("outcomes").where("key = 'k1'").collect()) == ["conflict", "conflict", "replay", "stored"]


def test_pages_are_neither_lost_nor_stored_twice(spark, tmp_path, monkeypatch):
    root = tmp_path / "pages"

    def page(stream, n, *rows):
        (root / stream).mkdir(parents=True, exist_ok=True)
        (root / stream / f"{n}.json").write_text(json.dumps(rows))

    for n in range(3):
        page("hr", n, {"v": n}, {"v": n + 0.5})
    page("steps", 0, {"v": 9})
    options = {"streams": "hr,steps", "root": str(root), "pages_at_once": "2"}
    store = RawStore(spark, "file://" + str(tmp_path / "store"))

    def go(checkpoint):
        q = ingest.run_pages(store, options, str(tmp_path / checkpoint))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    real = RawStore._finish
    monkeypatch.setattr(RawStore, "_finish", lambda self, name: 1 / 0)  # killed between the page and the commit
    try:
        go("cp")
    except Exception:  # noqa: BLE001, S110
        pass
    monkeypatch.setattr(RawStore, "_finish", real)
    want = lambda hr: sorted([("hr", n, k) for n in range(hr) for k in (0, 1)] + [("steps", 0, 0)])
    got = lambda: sorted((r.stream, r.page, r.position) for r in store.raw().collect())
    go("cp")
    assert got() == want(3) and {r.stream: r.next for r in store.cursors().collect()} == {"hr": 3, "steps": 1}
    page("hr", 3, {"v": 3}, {"v": 3.5})
    go("cp")
    assert got() == want(4)
    go("fresh")  # another checkpoint reads all pages once more
    assert got() == want(4)


def test_sessions_in_any_order_equal_those_of_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(4)
    day = 86_400_000_000
    spans = [(o, s, lo := rnd.randrange(0, 40) * day // 3, lo + rnd.choice([0, day // 10, day, 9 * day])) for o in range(3) for s in ("a", "b") for _ in range(12)]
    gap = day // 4
    df = spark.createDataFrame(spans, "owner long, source string, lo long, hi long")
    want = sorted(tuple(r) for r in episodes.fragments(df, ["owner", "source"], gap=gap).select("owner", "source", "lo", "hi", "pieces").collect())
    rnd.shuffle(spans)
    box = tmp_path / "spans"
    box.mkdir()
    for n in range(4):
        (box / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("owner", "source", "lo", "hi"), r))) for r in spans[n::4]))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(box))
    out = str(tmp_path / "out")
    q = sessions.sessions(stream, gap).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in sessions.current(spark.read.parquet(out)).collect()) == want
