"""Late, corrected and deleted rows through a stream, given twice, against building everything from the rows that are left."""

import datetime
import json
import shutil

from pyspark.sql import functions as F

from strandline.operators import gold
from strandline.streaming.marks import ROW, Store, last_of_batch, run


def row(key, owner, minute, value, seq, last=0, **more):
    at = datetime.datetime(2024, 3, 1) + datetime.timedelta(minutes=minute)
    return {"key": key, "owner": owner, "source": "interval" if last else "sample", "zone": "Asia/Kolkata", "start_at": at.isoformat() + "Z", "end_at": (at + datetime.timedelta(minutes=last)).isoformat() + "Z", "value": value, "deleted": False, "seq": seq} | more


def test_a_stream_ends_where_a_rebuild_would(spark, tmp_path):
    inbox, interval = tmp_path / "in", F.col("source") == "interval"
    inbox.mkdir()
    first = [row(f"a{i}", i % 3, 37 * i, float(i), 1, 50 * (i % 2)) for i in range(120)]
    second = [row("a5", 2, 185, 99.0, 2, 50), row("a7", 1, 9000, 7.0, 2, 50), row("a9", 0, 333, 0.0, 2, 50, deleted=True), row("late", 1, 3, 4.0, 2), row("a11", 2, 0, -1.0, 0), row("a12", 0, 37 * 12, 12.0, 2), row("never", 0, 5, 1.0, 2, deleted=True)]
    third = [row("a7", 1, 20, 8.0, 3, 50), row("late", 1, 3, 4.0, 1), row("a9", 0, 333, 3.0, 3, 50)]
    for i, rows in enumerate((first, second, third)):
        (inbox / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    store = Store(spark, "file://" + str(tmp_path / "store"), interval)
    run(store, str(inbox), str(tmp_path / "cp")).awaitTermination()

    alive = {}
    for r in first + second + third:
        if r["key"] not in alive or r["seq"] > alive[r["key"]]["seq"]:
            alive[r["key"]] = r
    alive = {k: r for k, r in alive.items() if not r["deleted"]}
    got = {r.key: (r.value, r.seq) for r in store.table("rows").collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: r["value"] for k, r in alive.items()}
    left = spark.read.schema(ROW).json(spark.sparkContext.parallelize([json.dumps(r) for r in alive.values()]))

    def plain(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())

    want = gold.hourly(left, ["owner", "source"], interval)
    assert plain(store.table("hours").select(want.columns)) == plain(want)

    # the same batches again change nothing, nor do they under a new checkpoint
    before, kept = plain(store.table("hours")), sorted(map(str, store.table("rows").collect()))
    run(store, str(inbox), str(tmp_path / "another")).awaitTermination()
    shutil.rmtree(tmp_path / "store" / "done")
    run(store, str(inbox), str(tmp_path / "third")).awaitTermination()
    assert plain(store.table("hours")) == before and sorted(map(str, store.table("rows").collect())) == kept
    assert store.pending().count() == 0


def test_a_new_checkpoint_and_a_second_stream_lose_nothing(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"), F.col("source") == "interval")
    for n in range(3):  # every stream counts its batches from 0
        box = tmp_path / f"in{n}"
        box.mkdir()
        (box / "0.json").write_text(json.dumps(row(f"k{n}", n, 10 * n, 1.0, 1)))
        run(store, str(box), str(tmp_path / f"cp{n}")).awaitTermination()
    assert {r.key for r in store.table("rows").collect()} == {"k0", "k1", "k2"}
    (tmp_path / "in0" / "1.json").write_text(json.dumps(row("k3", 0, 50, 2.0, 1)))
    run(store, str(tmp_path / "in0"), str(tmp_path / "new")).awaitTermination()
    assert store.table("rows").count() == 4 and store.table("hours").agg(F.sum("samples")).first()[0] == 4


def batch(spark, *rows):
    return spark.read.schema(ROW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_marks_settle_and_those_that_come_during_a_rebuild_survive_it(spark, tmp_path, monkeypatch):
    now = [1000.0]
    store = Store(spark, "file://" + str(tmp_path / "store"), F.col("source") == "interval", settle=60, clock=lambda: now[0])
    store.apply(batch(spark, row("a", 1, 0, 1.0, 1), row("far", 1, 60 * 24 * 40, 1.0, 1)))
    assert store.rebuild() == 0 and store.table("hours").count() == 0 and store.pending().count() == 2
    now[0] = 1061.0
    real = store._plan_hours

    def interrupted(at):
        name = real(at)
        if name is not None and now[0] == 1061.0:
            now[0] = 1062.0
            store._plan_rows(batch(spark, row("b", 1, 5, 2.0, 1)), "rows-late")  # written while the hours are not yet replaced
        return name

    monkeypatch.setattr(store, "_plan_hours", interrupted)
    assert store.rebuild() == 2  # two runs of 31 days
    assert [(r.local_date.isoformat(), r.arrived) for r in store.pending().collect()] == [("2024-03-01", 1062.0)]
    assert store.table("hours").agg(F.sum("samples")).first()[0] == 2
    store.compact()
    assert store.pending().count() == 1
    now[0] = 1200.0
    assert store.rebuild() == 1 and store.pending().count() == 0
    assert store.table("hours").agg(F.sum("samples")).first()[0] == 3


def test_a_step_that_is_cut_short_is_finished_first(spark, tmp_path, monkeypatch):
    store = Store(spark, "file://" + str(tmp_path / "store"), F.col("source") == "interval")
    store.apply(batch(spark, row("a", 1, 0, 1.0, 1)))
    real = Store._replace
    for fail_at in ("rows", "hours"):
        def broken(self, name, df, parts, fail_at=fail_at):
            if name == fail_at:
                raise RuntimeError("the driver is gone")
            real(self, name, df, parts)

        monkeypatch.setattr(Store, "_replace", broken)
        new = batch(spark, row(f"new-{fail_at}", 1, 20, 5.0, 1))
        try:
            store.apply(new)
        except RuntimeError:
            pass
        monkeypatch.setattr(Store, "_replace", real)
        store.apply(new)
    store.rebuild()
    assert {r.key for r in store.table("rows").collect()} == {"a", "new-rows", "new-hours"}
    assert store.table("hours").agg(F.sum("samples")).first()[0] == 3 and store._names("plan") == []


def test_a_batch_reads_its_own_parts_only(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"), F.col("source") == "interval")
    store.apply(batch(spark, *[row(f"k{o}-{d}", o, 1440 * d, 1.0, 1) for o in range(40) for d in range(20)]))
    every = len(store._read("rows").inputFiles())
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "rows").rglob("*.parquet")}
    store.apply(batch(spark, row("k3-4", 3, 1440 * 9, 2.0, 2)))  # one row moves to another date
    changed = {p for p in (tmp_path / "store" / "rows").rglob("*.parquet") if stamp.get(p) != p.stat().st_mtime_ns}
    assert every > 200 and {p.parent.name for p in changed} <= {"local_date=2024-03-05", "local_date=2024-03-10"} and len({p.parent.parent.name for p in changed}) == 1
    keys = last_of_batch(batch(spark, row("k3-4", 3, 1440 * 9, 2.0, 2))).withColumn("kb", F.pmod(F.xxhash64("key"), F.lit(Store.KEYS)).cast("int"))
    assert len(store._known(keys).inputFiles()) == 1 and len(store._read("rows", store._parts(keys)).inputFiles()) == 1
    assert store.table("rows").where("key = 'k3-4'").first().value == 2.0 and store.table("rows").count() == 800


def test_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("")
    store = Store(spark, "file://" + str(tmp_path / "store"), F.col("source") == "interval")
    run(store, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert store.table("rows").count() == 0 and store.table("hours").count() == 0
