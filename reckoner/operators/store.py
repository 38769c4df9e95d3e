"""The report store: upserts, reads, retention, listings, over plain tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reckoner.functions import scalars as S

REPORT_DAYS, JOB_DAYS, HISTORY = 90, 7, 50


def upsert_reports(store: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The store after a batch (upload_id, report_json, fa_input, history, filed_by).

    created_at and ttl are set once, updated_at always; a null filer doesn't replace one.
    """
    new = batch.select(F.col("upload_id"), *[F.col(c).alias(f"_{c}") for c in ("report_json", "fa_input", "history", "filed_by")], F.lit(True).alias("_new"))
    j = store.join(new, "upload_id", "full_outer")
    recent = F.slice("_history", F.greatest(F.lit(1), F.size("_history") - HISTORY + 1), HISTORY)
    pick = lambda c, v: F.when(F.col("_new"), v).otherwise(F.col(c)).alias(c)
    created = F.coalesce("created_at", now)
    return j.select(
        "upload_id",
        pick("report_json", F.col("_report_json")),
        pick("fa_input", F.coalesce("_fa_input", "fa_input")),
        pick("history", F.when(F.col("_history").isNotNull(), recent).otherwise(F.col("history"))),
        F.coalesce("_filed_by", "filed_by").alias("filed_by"),
        created.alias("created_at"),
        pick("updated_at", now),
        F.coalesce("ttl", created + F.expr(f"interval {REPORT_DAYS} days")).alias("ttl"),
    )


def get_reports(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("upload_id").distinct(), "upload_id", "left_semi").drop("created_at", "updated_at", "ttl")


def delete_reports(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("upload_id"), "upload_id", "left_anti")


def upsert_jobs(store: DataFrame, updates: DataFrame, now: Column, key: str = "job_id") -> DataFrame:
    """Partial merge: columns that an update leaves null keep their value."""
    fields = [c for c in updates.columns if c != key]
    any_set = F.lit(False)
    for c in fields:
        any_set = any_set | F.col(c).isNotNull()
    new = updates.where(any_set).select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    j = store.join(new, key, "full_outer")
    ttl = F.when(F.col("_new"), now + F.expr(f"interval {JOB_DAYS} days")).otherwise(F.col("ttl"))
    return j.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields], ttl.alias("ttl"))


def retained(store: DataFrame, now: Column) -> DataFrame:
    return store.where(F.col("ttl") > now)


def listing(reports: DataFrame, filer: Column | None = None, limit: int = 100) -> DataFrame:
    """Newest reports first, those without a time last; a filer sees only their own."""
    mine = reports.where(F.col("filed_by").isNotNull() & (F.col("filed_by") == filer)) if filer is not None else reports
    return mine.orderBy(F.desc_nulls_last("updated_at"), "upload_id").limit(limit)


def with_collision_suffix(files: DataFrame) -> DataFrame:
    """``files`` (upload_id, seq, name) with unique_name, in the order of seq: a name that
    is taken gets the first free number from 2 on (name_2.pdf).

    Each name depends on all before it. The files of an upload are gathered into one row, without a
    shuffle where they are together already, and uploads go through Python in Arrow batches, a
    list of names at a time. Rows of equal seq are taken by name; a null name stays null; files
    without an upload keep their names.
    """
    rest = [c for c in files.columns if c != "upload_id"]
    gathered = files.groupBy("upload_id").agg(F.collect_list(F.struct(*rest)).alias("_files"))
    out = T.StructType([*files.schema.fields, T.StructField("unique_name", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few uploads at a time, as one may have many files.
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, lists = part.column(0), part.column(1)
                columns = dict(zip(rest, lists.flatten().flatten(), strict=True)) | {"upload_id": ids.take(pc.list_parent_indices(lists))}
                seqs, names, unique, begin = columns["seq"].to_pylist(), columns["name"].to_pylist(), [], 0
                for upload, n in zip(ids.to_pylist(), pc.list_value_length(lists).to_pylist(), strict=True):
                    unique += names[begin : begin + n] if upload is None else _numbered(seqs[begin : begin + n], names[begin : begin + n])
                    begin += n
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in list(arrow)[:-1]] + [pa.array(unique, pa.string())], schema=arrow)

    return gathered.mapInArrow(run, out)


@lru_cache(1 << 16)
def _cut(name: str) -> tuple[str, str]:
    path = PurePosixPath(name)
    return path.stem, path.suffix


def _numbered(seqs: list, names: list[str | None]) -> list[str | None]:
    seen: set[str | None] = set(names)
    if len(seen) == len(names):
        return names
    seen.clear()
    counters: dict[str, int] = {}
    out: list[str | None] = [None] * len(names)
    for i in sorted(range(len(names)), key=lambda i: (seqs[i] is None, 0 if seqs[i] is None else seqs[i], names[i] or "")):
        name = names[i]
        if name is None:
            continue
        if name in seen:
            k = counters.get(name, 2)
            stem, suffix = _cut(name)
            while (made := f"{stem}_{k}{suffix}") in seen:
                k += 1
            counters[name] = k + 1
            name = made
        out[i] = name
        seen.add(name)
    return out


# Names of users that belong to tests.
TEST_USERS = (
    "^fmtest$",
    "^fxtest$",
    "^e2etest$",
    "^scope_[0-9a-f]+$",
    "^hist[0-9a-f]+$",
    "^pipelinetest[0-9]*$",
)


def is_test_report(upload_id: Column, user: Column, patterns: tuple[str, ...] = TEST_USERS) -> Column:
    found = upload_id.startswith("test_")
    for p in patterns:
        found = found | F.coalesce(user.rlike(p), F.lit(False))
    return found


def add_receipts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old extractions, less those that a new file with the same stem replaces, and the new."""
    stem = F.regexp_replace("source_filename", r"\.[^.]*$", "")
    keys = new.select("report_id", stem.alias("_stem")).distinct()
    kept = old.withColumn("_stem", stem).join(keys, ["report_id", "_stem"], "left_anti").drop("_stem")
    return kept.unionByName(new)


def clean_names(files: DataFrame) -> DataFrame:
    return files.withColumn("name", S.sanitize_filename(F.col("name")))
