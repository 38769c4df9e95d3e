"""What showed on larger tables only: limits of rows, ties of roundings, many small things."""

from __future__ import annotations

import json
import random
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from reckoner.operators import grounding, quality, store, tree
from reckoner.plans import trees
from reckoner.sources import portal, views

ODD = [
    {"x": {"value": 1.10, "_meta": {"confidence": "high", "evidence": [{"kind": "document", "bboxes": [[0.1, 1.0]]}, {"kind": "k", "bboxes": None}, {"bboxes": []}]}}, "y": {"value": "t", "_meta": {"confidence": "medium", "needs_review": True}}},
    {"z": {"value": None, "_meta": {"confidence": "high"}}, "w": {"value": 1}, "bare": "b", "deep": [{"v": {"value": False, "_meta": {"confidence": "low", "evidence": []}}}, {"v": {"value": 2, "_meta": {}}}]},
    {"value": {"_meta": {"value": 3}}, "a": {"_meta": {"confidence": None}}, "n": {"value": {"value": 5}}},
    {},
    [],
    {"only": {"value": None, "_meta": {"confidence": "high"}}},
    {"k[3]": "é\n", "b.c": [[], {}, None, "", -2e10]},
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_are_rounded_as_their_sql_rounds_them(spark, tmp_path):
    prices = [35155.0, 411185.0, 439385.0, 148975.0, 141925.0, 12345.0, 99999.99]
    rows = spark.createDataFrame([(5 * k, p, f"2024-01-{k + 1:02d}") for k, p in enumerate(prices)], "o_orderkey long, o_totalprice double, day string")
    rows.select("o_orderkey", "o_totalprice", F.to_timestamp("day").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = [x["usd_per_unit"] for x in views.fx_rates(spark, str(tmp_path)).orderBy("rate_date").collect()]
    assert got == [duckdb.sql(f"SELECT round(CAST({p} AS DOUBLE) / 100000, 4)").fetchall()[0][0] for p in prices] and got[0] == 0.3515


def test_leaves_of_more_documents_than_a_recursive_query_takes(spark):
    docs = spark.range(600_000).select(F.col("id").alias("document_id"), F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("json"))
    found = quality.leaves(docs)
    assert found.agg(F.count("*"), F.sum(F.col("value").cast("long")), F.count_distinct("path")).first()[:] == (600_000, 600_000 * 599_999 // 2, 1)


def test_leaves_of_odd_texts(spark):
    value = {"a": [], "b": {}, "c": "[]", "d": None, "e": [[1, {"f": True}], "x"], "g": 1.5}
    texts = {"v": json.dumps(value), "null": None, "bad": "{", "bare": "7", "word": "null", "deep": "[" * 12 + "1" + "]" * 12}
    found = quality.leaves(spark.createDataFrame(list(texts.items()), "document_id string, json string"))
    got = {(x["document_id"], x["path"]): (x["value"], x["kind"]) for x in found.collect()}
    assert got == {
        ("v", "$.a"): ("[]", "ARRAY<VOID>"), ("v", "$.b"): ("{}", "OBJECT<>"), ("v", "$.c"): ("[]", "STRING"), ("v", "$.d"): (None, "VOID"), ("v", "$.e[0][0]"): ("1", "BIGINT"),
        ("v", "$.e[0][1].f"): ("true", "BOOLEAN"), ("v", "$.e[1]"): ("x", "STRING"), ("v", "$.g"): ("1.5", "DECIMAL(2,1)"), ("bare", "$"): ("7", "BIGINT"), ("word", "$"): (None, "VOID"), ("deep", "$" + "[0]" * 12): ("1", "BIGINT"),
    }
    with pytest.raises(Exception, match="nested deeper"):
        quality.leaves(spark.createDataFrame([("d", "[" * 13 + "1" + "]" * 13)], "document_id string, json string")).collect()


def odd_documents(spark):
    texts = [json.dumps(x, ensure_ascii=k % 2 == 0) for k, x in enumerate(ODD)] + ['{"a": 1.10, "a": 2}', '{"s": "\\ud83d x \\ud83d\\ude00"}', "[1,]", None, "NaN", '{"n": -Infinity}', "[" * 3000 + "1.10" + "]" * 3000]
    return spark.createDataFrame(list(enumerate(texts)), "document_id long, json string").repartition(3)


def test_documents_are_measured_where_they_are_read(spark):
    docs = odd_documents(spark)
    leaves = tree.leaves(docs, root="r").cache()
    said = F.struct("path", F.concat("path", F.lit("="), "kind", F.lit(":"), "value").alias("said"))
    old = leaves.groupBy("document_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(said)).alias("all")).select("document_id", "n", F.md5(F.array_join("all.said", "\n")))
    assert sorted(map(tuple, tree.digests(docs, root="r").collect())) == sorted(map(tuple, old.collect()))
    template = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    old = leaves.groupBy(template, "kind").agg(F.count("*"), F.min("value"), F.max("value"))
    assert sorted(map(str, map(tuple, tree.templates(docs, root="r").collect()))) == sorted(map(str, map(tuple, old.collect())))
    meta = tree.with_meta(leaves).cache()
    got = {x["document_id"]: x for x in tree.meta_counts(docs).collect()}
    levels = {x["document_id"]: tuple(x)[1:] for x in tree.written_confidences(meta).collect()}
    assert {k: (x["n_high"], x["n_medium"], x["n_low"]) for k, x in got.items() if x["n_wrapped"]} == levels
    assert {k: (x["n_evidence"], x["n_grounded"]) for k, x in got.items() if x["n_leaves"]} == {x["document_id"]: tuple(x)[1:] for x in tree.grounded_evidence(meta).collect()}
    assert levels[0] == (1, 1, 0) and got[0]["n_evidence"] == 4 - 1 and got[5]["n_leaves"] == 0
    assert leaves.where("document_id = 13").first()["value"] == "1.10" and leaves.where("document_id in (9, 10, 11, 12)").count() == 0


@pytest.mark.parametrize("name", ["S23", "L01_nested", "A13_all", "A22"])
def test_leaves_of_reports_are_not_shuffled(spark, name):
    plan = plan_of(trees.QUERIES[name](spark, "/root/testdata/sf0.001"))
    # Lines once by report, reports at most once, and the counts of a task's templates.
    assert 1 <= plan.count("Exchange hashpartitioning") <= 3 and "Generate" not in plan


def test_only_reports_that_are_asked_for_are_nested(spark):
    asked = spark.createDataFrame([(3,), (5,), (10**9,)], "report_id long")
    every = {x["report_id"]: x["json"] for x in trees.nested_reports(spark, "/root/testdata/sf0.001").where("report_id in (3, 5)").collect()}
    assert {x["report_id"]: x["json"] for x in trees.nested_reports(spark, "/root/testdata/sf0.001", asked).collect()} == every and len(every) == 2


def test_names_of_many_uploads(spark):
    names = ["a.png", "a_2.png", "a.png", "a_2_2.png", "a.png", "a_2.png"]
    files = spark.range(3000).select((F.col("id") % 500).alias("n"), F.col("id").alias("upload_id"), F.posexplode(F.array(*[F.lit(x) for x in names])).alias("seq", "name"))
    odd = spark.createDataFrame([(1, None, 0, "x"), (2, None, 1, "x"), (3, 9999, 1, None), (4, 9999, 2, None), (5, 9999, None, "b"), (6, 9999, 0, "b")], "n long, upload_id long, seq int, name string")
    found = store.with_collision_suffix(files.unionByName(odd).repartition(7))
    want = ["a.png", "a_2.png", "a_3.png", "a_2_2.png", "a_4.png", "a_2_3.png"]
    every = found.where("upload_id < 3000").groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "unique_name", "n"))).alias("x")).collect()
    assert len(every) == 3000 and all([tuple(y) for y in r["x"]] == [(k, names[k], want[k], r["upload_id"] % 500) for k in range(6)] for r in every)
    assert sorted((x["n"], x["unique_name"]) for x in found.where("upload_id is null or upload_id = 9999").collect()) == [(1, "x"), (2, "x"), (3, None), (4, None), (5, "b_2"), (6, "b")]
    # One row at a time for each upload was a call for each; now a task's uploads share a call.
    assert "FlatMapGroups" not in plan_of(found) and "MapInArrow" in plan_of(found)


PAGES = [("r1", 2, "b,c", None), ("r1", 1, 'say "x"', "y"), ("r/2", 1, "two\nlines", ""), ("r_2", 2, "é", "z"), ("r4", 10, "ten", "t"), ("r4", 9, "nine", "n"), ("x" * 150, 1, "long", "l")]


def test_archives_hold_the_same_files(spark, tmp_path):
    rows = spark.createDataFrame(PAGES, "report_id string, line int, a string, b string").repartition(3)
    reports = spark.createDataFrame([(r,) for r in ("r1", "r/2", "r_2", "none", "r4", "x" * 150)], "report_id string")
    header = ["Line", "A", "B  (x)"]
    portal.write_files(rows, reports, f"file://{tmp_path}/files", "domestic", header, "line")
    portal.write_archives(rows, reports, f"file://{tmp_path}/packed", "domestic", header, "line")
    packed = {}
    for path in (tmp_path / "packed").glob("*.tar.gz"):
        with tarfile.open(path) as t:
            packed |= {m.name: t.extractfile(m).read() for m in t}
    assert packed == {p.name: p.read_bytes() for p in (tmp_path / "files").glob("*.csv")} and len(packed) == 5
    assert (tmp_path / "packed/_SUCCESS").read_text() == (tmp_path / "files/_SUCCESS").read_text()
    one, two = (sorted(map(tuple, f(spark, f"file://{tmp_path}/{d}", "domestic", ["line", "a", "b"]).collect())) for f, d in ((portal.read_files, "files"), (portal.read_archives, "packed")))
    assert one == two and len(one) == len(PAGES)
    assert not [p for p in (tmp_path / "packed").iterdir() if p.name.startswith("_") and p.name != "_SUCCESS"]


def test_archives_of_many_none_and_failed_reports(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("report_id"), F.floor(F.col("id") / 5000).alias("line"), F.concat(F.lit("a"), "id").alias("a"))
    reports = spark.range(6000).select(F.col("id").alias("report_id"))
    portal.write_archives(rows, reports, f"file://{tmp_path}/out", "p", ["A"], "line")
    back = portal.read_archives(spark, f"file://{tmp_path}/out", "p", ["a"])
    assert sorted(map(tuple, back.collect())) == sorted((str(k % 5000), f"a{k}") for k in range(20_000))
    # Before, a file of its own for each report: 6000 here, nine millions at 1 GB.
    assert json.loads((tmp_path / "out/_SUCCESS").read_text()) == {"files": 6000, "lines": 26_000} and len(list((tmp_path / "out").glob("*.tar.gz"))) <= 200
    bad = rows.withColumn("a", F.when(F.col("line") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="broken"):
        portal.write_archives(bad, reports, f"file://{tmp_path}/bad", "p", ["A"], "line")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    portal.write_archives(rows.limit(0), reports.limit(0), f"file://{tmp_path}/none", "p", ["A"], "line")
    assert portal.read_archives(spark, f"file://{tmp_path}/none", "p", ["a"]).count() == 0


def test_documents_with_their_tokens_are_grounded_alike(spark):
    r = random.Random(7)
    word = lambda: r.choice(["fare", "paid", "in", "new-york/city", "$42.50", " ", "$", "aaaa", "hall", "é"])
    tokens = [(k, p, i, word(), r.choice([[float(i), 0.0, i + 1.0, 1.0], [float(i), 0.0, i + 1.0, 1.0], None])) for k in range(30) for p in (1, 2, 5) for i in range(r.randint(0, 12))]
    evidence = [(f"{k}/{n}", k, r.choice([1, 2, 5, 9, None]), r.choice([None, "$", " ".join(word() for _ in range(r.randint(1, 5)))]), r.choice([None, [], [1, 2], [3, 2, 99], [0]])) for k in range(30) for n in range(6)]
    t = spark.createDataFrame(tokens, "doc_id long, page int, pos int, text string, box array<double>")
    e = spark.createDataFrame(evidence, "evidence_id string, doc_id long, page int, quote string, token_ids array<long>")
    old = grounding.ground(e, grounding.number_tokens(t)).collect()
    gathered = lambda df, name: df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
    docs = gathered(e, "evidence").join(gathered(t, "tokens"), "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array()))
    new = grounding.ground_documents(docs).collect()
    assert sorted(map(str, new)) == sorted(map(str, old)) and {x["how"] for x in new} == {"tokens", "search", None} and {x["level"] for x in new} >= {0, 2, None}
    plan = plan_of(trees.QUERIES["G01_levels"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan and "Join" not in plan
