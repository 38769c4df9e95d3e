"""Readers and small operators, each on a file or a few rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import export, jobs, store
from reckoner.sources import readers


def write(path, name, value):
    path.mkdir(exist_ok=True)
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_reports_are_unwrapped_and_bad_ones_marked(spark, tmp_path):
    for name, value in {"a.json": {"expense_report": {"x": 1}}, "b.json": {"x": 2}, "c.json": "{broken", "d.json": {"expense_report": 5}}.items():
        path = write(tmp_path / "r", name, value)
    rows = {r["file_name"]: r for r in readers.read_reports(spark, path).select("file_name", F.try_variant_get("report", "$.x", "int").alias("x"), "is_bad").collect()}
    assert {k: (r["x"], r["is_bad"]) for k, r in rows.items()} == {"a.json": (1, False), "b.json": (2, False), "c.json": (None, True), "d.json": (None, True)}


def test_extractions_have_one_receipt_a_file(spark, tmp_path):
    path = write(tmp_path / "e", "b.json", [{"source_filename": "b.pdf"}])
    write(tmp_path / "e", "a.json", [{"source_filename": "a.pdf"}])
    both = readers.read_extractions(spark, path).withColumn("report_id", F.lit(1))
    assert [(r["file_name"], r["line_idx"]) for r in readers.line_index(both).orderBy("line_idx").collect()] == [("a.json", 0), ("b.json", 1)]
    write(tmp_path / "e", "c.json", [])
    assert readers.read_extractions(spark, path, strict=False).count() == 2
    with pytest.raises(Exception, match="no receipt in c.json"):
        readers.read_extractions(spark, path).collect()


def test_manifests_artifacts_and_airports(spark, tmp_path):
    path = write(tmp_path / "m", "m.json", {"corpus_name": "c", "documents": [{"document_id": "d1", "kind": "meal", "tags": ["t"], "expected_fields": {"a": "1"}}, {"document_id": "d2"}]})
    got = readers.read_manifests(spark, path).orderBy("document_id").collect()
    assert [(r["corpus_name"], r["document_id"], r["tags"]) for r in got] == [("c", "d1", ["t"]), ("c", "d2", None)] and got[0]["expected_fields"] == {"a": "1"}
    for upload, category, name in (("u1", "files", "x.pdf"), ("u1", "extractions", "x.json"), ("u2", "files", "y.pdf")):
        (tmp_path / "uploads" / upload / category).mkdir(parents=True, exist_ok=True)
        (tmp_path / "uploads" / upload / category / name).write_bytes(b"12345")
    found = {tuple(r) for r in readers.list_artifacts(spark, str(tmp_path / "uploads")).collect()}
    assert found == {("u1", "files", "x.pdf", 5), ("u1", "extractions", "x.json", 5), ("u2", "files", "y.pdf", 5)}
    rows = spark.createDataFrame([(0, "SFO - San Francisco"), (1, "SFO - Other"), (2, "no code"), (3, "ZZZZZ - long"), (4, "LHR - London")], "pos int, text string")
    airports = readers.airport_dim(rows)
    assert {tuple(r) for r in airports.collect()} == {("SFO", "SFO - San Francisco"), ("LHR", "LHR - London")}
    flights = spark.createDataFrame([(1, " sfo", "XXX"), (2, None, "LHR")], "id int, departure_airport string, destination_airport string")
    assert [tuple(r)[1:] for r in export.airport_names(flights, airports).orderBy("id").select("id", "departure_airport", "destination_airport").collect()] == [("SFO - San Francisco", "XXX"), (None, "LHR - London")]


def test_logs(spark, tmp_path):
    path = write(tmp_path / "l", "a.log", '{"severity": "INFO", "event": "x.start", "timestamp": 1.5, "n": 3}\nnot json\n{"event": "y"}\n')
    got = readers_log = jobs.read_log(spark, path).select("severity", "event", F.unix_micros("ts").alias("us"), F.try_variant_get("props", "$.n", "int").alias("n")).collect()
    assert [tuple(r) for r in got] == [("INFO", "x.start", 1_500_000, 3), (None, "y", None, None)] and readers_log


def test_stored_reports_are_read_and_deleted(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "upload_id string, report_json string").withColumns({c: F.current_timestamp() for c in ("created_at", "updated_at", "ttl")})
    ids = spark.createDataFrame([("a",), ("a",), ("x",)], "upload_id string")
    assert [tuple(r) for r in store.get_reports(rows, ids).collect()] == [("a", "1")]
    assert sorted(r["upload_id"] for r in store.delete_reports(rows, ids).collect()) == ["b", "c"]


def test_boxes_of_vertices(spark):
    df = spark.createDataFrame([([(3.0, 1.0), (1.0, 5.0), (2.0, 2.0)],), ([],), (None,)], "v array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(S.vertices_to_bbox(F.col("v"))).collect()] == [[1.0, 1.0, 3.0, 5.0], None, None]
