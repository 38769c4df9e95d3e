"""The corpus pipeline on planted cases, and its stages against plain versions."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers

from reckoner.llm import maxplus

BAD = ["vileword", "nastiness", "scumbagger", "worthlessly"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(60)}" for _ in range(n))


def test_planted_cases(spark, tmp_path):
    item = text(999, 25)
    rows, labels = [], []
    for k in range(240):
        w = text(k, 60).split()
        toxic = k % 4 == 0
        if toxic:
            r = random.Random(k)
            for _ in range(6):
                w[r.randrange(60)] = r.choice(BAD)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    clean = [k for k in range(240) if k % 4]
    rows += [(300, rows[1][1]), (301, rows[2][1].upper()), (302, rows[3][1] + " extra"), (303, f"{text(5000, 20)} {item} {text(5001, 20)}"), (304, None), (305, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    read, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, str(tmp_path))
        if name != "pieces":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in read.select("doc_id").collect()}
    others = {304, 305}
    assert kept["toxicity"] >= {*clean, 300, 301, 302, 303, *others} and not kept["toxicity"] & {k for k in range(240) if k % 4 == 0}
    assert kept["near_duplicates"] == {*clean, 303, *others}
    assert kept["decontamination"] == kept["pieces"] == {*clean, *others}
    by_id = dict(rows)
    assert all(maxplus.decode(r["ids"], public_tokenizers.path("piece_bpe_32k.model")) == (by_id[r["doc_id"]] or "") for r in read.collect())
    assert spark.read.parquet(str(tmp_path / "toxicity")).where("score = 0.5").count() == len(kept["toxicity"])


def tables(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(path / "documents.parquet"))
    known = [(k, 1, k % 2) for k in range(6)]
    spark.createDataFrame(known, "doc_id long, quality long, toxic long").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))


def test_no_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_columns(spark, tmp_path):
    long = text(8, 30000)
    rows = [(None, "a b c d e f", None, None, None), (None, None, None, "s", 0), (7, text(7, 50), "en", "s", 1), (7, text(7, 50), "en", "s", 1), (9, text(7, 50), "en", "s", 1), (11, "", None, None, 0), (12, long, "en", "s", len(long))]
    tables(spark, tmp_path, rows)
    got = [(r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # One row of 7 and its copies stays; rows without an id stay.
    assert sorted(i for i, _ in got if i is not None) == [7, 11, 12] and sorted(n > 0 for i, n in got if i is None) == [False, True]
    assert max(n for _, n in got) > 30000
