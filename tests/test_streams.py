"""Streams: what readers are told, and receipts that arrive in parts."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from reckoner.streaming import progress, versions


@pytest.fixture
def with_store(spark):
    before = {k: spark.conf.get(k) for k in progress.STORE}
    for k, v in progress.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_readers_are_told_of_lost_and_unknown_uploads(with_store, tmp_path):
    spark, source = with_store, tmp_path / "in"
    source.mkdir()
    t = lambda n: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)).isoformat()

    def arrive(name, *rows):
        (tmp_path / name).write_text("".join(json.dumps(dict(zip(("upload_id", "event", "phase", "ts"), r, strict=True))) + "\n" for r in rows))
        (tmp_path / name).rename(source / name)

    arrive("a.json", ("lost", "upload", None, t(0)), ("lost", "watch", None, t(1)), ("late", "watch", None, t(1)), ("late", "upload", None, t(0)), ("none", "watch", None, t(1)), ("ready", "upload", None, t(0)), ("ready", "job", "done", t(1)), ("ready", "watch", None, t(1)), ("odd", "other", None, t(0)))
    events = spark.readStream.schema("upload_id string, event string, phase string, ts timestamp").json(str(source))
    told = progress.told(events, ticks=20, tick_seconds=0.2)
    query = told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    read = lambda: [(r["upload_id"], r["state"]) for r in spark.table("told").collect()]
    try:
        for n, name, rows in ((5, "b.json", [("late", "job", "extract", t(5)), ("late", "job", "reduce", t(4))]), (6, "c.json", [("late", "job", "done", t(9)), ("late", "job", "error", t(10))])):
            deadline = time.time() + 60
            while len(read()) < n - 1 and query.isActive and time.time() < deadline:
                time.sleep(0.3)
            arrive(name, *rows)
        deadline = time.time() + 60
        while not {("lost", "lost"), ("late", "done")} <= set(read()) and query.isActive and time.time() < deadline:
            time.sleep(0.3)
        assert not query.exception(), str(query.exception())[:3000]
    finally:
        query.stop()
    got = read()
    of = lambda u: [s for x, s in got if x == u]
    assert of("lost") == ["initializing", "lost"] and of("none") == ["not_found"] and of("ready") == ["done"] and of("odd") == []
    # Older phases, and those after the end, aren't told.
    assert of("late")[0] == "initializing" and of("late")[-1] == "done" and "lost" not in of("late") and "error" not in of("late")


RECEIPTS = "report_id long, source_filename string, amount double"


def reduced(lines):
    return lines.groupBy("report_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max_by("source_filename", "line_idx").alias("last"))


def batches(tmp_path):
    parts = [[(1, "a.pdf", 1.0), (2, "a.pdf", 5.0)], [(1, "b.pdf", 2.0), (3, "x.pdf", 7.0), (1, "b.pdf", 2.0)], [(1, "a.png", 10.0), (None, "n.pdf", 1.5)], [(2, "c.pdf", 1.25)]]
    for k, rows in enumerate(parts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("report_id", "source_filename", "amount"), r, strict=True))) + "\n" for r in rows))
        time.sleep(0.02)
    return {(1, 2, 12.0, "b.pdf"), (2, 2, 6.25, "c.pdf"), (3, 1, 7.0, "x.pdf"), (None, 1, 1.5, "n.pdf")}


@pytest.mark.parametrize("fails_in", ["reports", "receipts"])
def test_a_stream_that_fails_half_way_and_restarts_gives_the_batch_result(spark, tmp_path, monkeypatch, fails_in):
    want = batches(tmp_path)
    receipts = versions.Versions(spark, str(tmp_path / "receipts"), "report_id", RECEIPTS, every=2)
    reports = versions.Versions(spark, str(tmp_path / "reports"), "report_id", "report_id long, n long, total double, last string", every=2)
    new = spark.readStream.schema(RECEIPTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    put, failed = versions.Versions.put, []

    def breaks(self, rows, touched, n):
        put(self, rows, touched, n)
        if n == 2 and not failed and self.path.endswith(fails_in):
            failed.append(n)
            raise RuntimeError("lost the machine")

    monkeypatch.setattr(versions.Versions, "put", breaks)
    start = lambda: versions.rereduce(new, receipts, reports, reduced).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost the machine"):
        start().awaitTermination()
    assert failed == [2]
    start().awaitTermination(120)
    assert {tuple(r) for r in reports.at().collect()} == want
    assert sorted(tuple(r)[1:] for r in receipts.at().collect()) == sorted([("a.pdf", 5.0), ("a.png", 10.0), ("b.pdf", 2.0), ("c.pdf", 1.25), ("n.pdf", 1.5), ("x.pdf", 7.0)])
    # As of an earlier batch, and without a batch.
    assert {tuple(r) for r in reports.at(0).collect()} == {(1, 1, 1.0, "a.pdf"), (2, 1, 5.0, "a.pdf")} and reports.at(-1).count() == 0


def test_keys_without_rows_are_gone(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"), "k", "k long, x string")
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, x string")
    v.put(make((1, "a"), (2, "b"), (2, "c")), make((1, ""), (2, "")), 0)
    v.put(make((1, "d")), make((1, ""), (2, "")), 1)
    v.put(make((1, "d")), make((1, ""), (2, "")), 1)
    assert [tuple(r) for r in v.at().collect()] == [(1, "d")] and v.at(0).count() == 3
