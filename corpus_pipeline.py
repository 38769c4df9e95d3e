"""From raw documents to piece ids: toxicity, near duplicates, benchmark, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. The first three filter and
return the columns of documents unchanged; the last returns doc_id, n_pieces and ids.

Defined results: a null or empty text is neither toxic nor contaminated nor a
duplicate, and has no pieces; rows of a repeated doc_id are one document, of which
deduplication leaves one row at most; columns that share a name with an operator's result pass through
unchanged; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import maxplus, neardup, tiling, toxicity
from reckoner.llm.common import fresh_path, table


def _filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], results: tuple[str, ...], keep: Column) -> DataFrame:
    """Rows of ``docs`` that ``keep`` holds for, its own columns untouched."""
    away = {c: f"_own_{c}" for c in docs.columns if c.lower() in results}
    back = {v: k for k, v in away.items()}
    judged = judge(docs.withColumnsRenamed(away)).where(keep)
    return judged.select(*[F.col(away.get(c, c)) for c in docs.columns]).withColumnsRenamed(back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't taken for toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: toxicity.score(d, model), ("score", "predicted"), F.col("predicted") == 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _filtered(docs, lambda d: tiling.decontaminate(d, benchmark), ("contaminated", "item_id", "coverage", "n_tiles"), ~F.col("contaminated"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of each document."""
    coded = maxplus.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pieces", piece_stage),
]

#: Trained models and best paths can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
