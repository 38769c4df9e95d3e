"""Quality of extractions: expectations, leaf diffs, drift of catalogues, edit audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckoner.functions import scalars as S


def leaves(docs: DataFrame, json: str = "json", depth: int = 12) -> DataFrame:
    """(document_id, path, value, kind) of every leaf of a JSON column; empty objects and arrays are leaves.

    Each level of the variants is a step of the same task, so any number of documents streams
    through (a recursive query has a limit of rows). A text nested deeper than ``depth`` is an error.
    """
    tvf = docs.sparkSession.tvf
    v, inner = F.col("v"), F.col("_inner")
    holds = F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<") & ~v.cast("string").isin("[]", "{}")
    here = docs.select("document_id", F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null").withColumn("_inner", holds)
    step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key"))
    for _ in range(depth):
        met = here.withColumn("_open", F.when(inner, v)).lateralJoin(tvf.variant_explode_outer(F.col("_open").outer()))
        here = met.select("document_id", F.when(inner, step).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("value")).otherwise(v).alias("v"), "_inner")
        here = here.withColumn("_inner", inner & holds)
    deep = F.raise_error(F.concat(F.lit(f"nested deeper than {depth} levels: "), "path")).cast("string")
    return here.select("document_id", F.when(inner, deep).otherwise(F.col("path")).alias("path"), v.cast("string").alias("value"), F.schema_of_variant(v).alias("kind"))


_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _arrays(leaf_table: DataFrame, length: str) -> DataFrame:
    """(document_id, path, length) of every array that a leaf stands in, or that is empty."""
    path = F.col("path")
    begins = F.filter(F.sequence(F.lit(1), F.length(path)), lambda k: F.substring(path, k, 1) == "[")
    inside = F.transform(begins, lambda k: F.struct(F.substring(path, F.lit(1), k - 1).alias("path"), (F.regexp_extract(F.substring(path, k, F.lit(12)), r"^\[([0-9]+)\]", 1).cast("int") + 1).alias("n")))
    each = leaf_table.select("document_id", F.inline(inside)).unionByName(leaf_table.where("kind = 'ARRAY<VOID>' and value = '[]'").select("document_id", "path", F.lit(0).alias("n")))
    return each.groupBy("document_id", "path").agg(F.max("n").alias(length))


def tree_diff(left: DataFrame, right: DataFrame, benign: tuple[str, ...] = ()) -> DataFrame:
    """Differences of two leaf tables (document_id, path, value; kind as ``leaves`` gives it).

    DROPPED, ADDED (those left out whose path ends in a ``benign`` one), NULL MISMATCH,
    TYPE, VALUE and ARRAY LENGTH. Numbers that are equal as numbers are equal. Below arrays
    of different lengths nothing else is reported. Without ``kind`` on both sides types
    and lengths aren't compared, and texts that are equal numbers are equal.
    """
    typed = "kind" in left.columns and "kind" in right.columns
    kinds = ["kind"] if typed else []
    a = left.select("document_id", "path", F.col("value").alias("left_value"), *[F.col(c).alias("_ka") for c in kinds], F.lit(True).alias("_a"))
    b = right.select("document_id", "path", F.col("value").alias("right_value"), *[F.col(c).alias("_kb") for c in kinds], F.lit(True).alias("_b"))
    j = a.join(b, ["document_id", "path"], "full_outer")
    l, r = F.col("left_value"), F.col("right_value")
    equal_numbers = F.coalesce(l.try_cast("double") == r.try_cast("double"), F.lit(False))
    same, other_type = l.eqNullSafe(r) | equal_numbers, F.lit(False)
    no_left, no_right = l.isNull(), r.isNull()
    if typed:
        kind = lambda c: F.when(F.col(c).rlike(_NUMBERS), "number").otherwise(F.col(c))
        no_left, no_right = l.isNull() | (F.col("_ka") == "VOID"), r.isNull() | (F.col("_kb") == "VOID")
        other_type = kind("_ka") != kind("_kb")
        same = (no_left & no_right) | (~other_type & (l.eqNullSafe(r) | ((kind("_ka") == "number") & equal_numbers)))
    found = F.when(F.col("_b").isNull(), "DROPPED").when(F.col("_a").isNull(), "ADDED").when(same, None).when(no_left != no_right, "NULL MISMATCH").when(other_type, "TYPE").otherwise("VALUE")
    out = j.withColumn("difference", found).where("difference is not null")
    skip = F.lit(False)
    for end in benign:
        skip = skip | F.col("path").endswith(end)
    out = out.where(~((F.col("difference") == "ADDED") & skip)).select("document_id", "path", "difference", "left_value", "right_value")
    if not typed:
        return out
    met = _arrays(left, "_l").join(_arrays(right, "_r"), ["document_id", "path"]).where("_l <> _r")
    lengths = met.select("document_id", "path", F.lit("ARRAY LENGTH").alias("difference"), F.col("_l").cast("string").alias("left_value"), F.col("_r").cast("string").alias("right_value"))
    # What stands below such an array (it, if it is empty) isn't reported on its own, nor an array inside it.
    outer = met.groupBy("document_id").agg(F.collect_set("path").alias("_outer"))
    below = lambda df: df.join(outer, "document_id", "left").where(~F.coalesce(F.exists("_outer", lambda x: F.startswith(F.col("path"), F.concat(x, F.lit("[")))), F.lit(False)))
    own = below(out).where(~F.coalesce(F.array_contains("_outer", F.col("path")), F.lit(False)))
    return own.drop("_outer").unionByName(below(lengths).drop("_outer"))


def expectations(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Outcome of each expectation (document_id, path, op, value) against leaves.

    ops: eq, is_null, contains, len_eq, len_ge, close (within 0.01).
    """
    j = expected.join(found.select("document_id", "path", F.col("value").alias("found"), F.lit(True).alias("_there")), ["document_id", "path"], "left")
    v, x = F.col("found"), F.col("value")
    ok = (
        F.when(F.col("op") == "eq", v.eqNullSafe(x) | F.coalesce(v.try_cast("double") == x.try_cast("double"), F.lit(False)))
        .when(F.col("op") == "is_null", v.isNull())
        .when(F.col("op") == "contains", F.contains(v, x))
        .when(F.col("op") == "len_eq", F.length(v) == x.try_cast("int"))
        .when(F.col("op") == "len_ge", F.length(v) >= x.try_cast("int"))
        .when(F.col("op") == "close", F.abs(v.try_cast("double") - x.try_cast("double")) <= 0.01)
    )
    outcome = F.when(F.col("_there").isNull() & (F.col("op") != "is_null"), "missing path").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("failed")
    return j.select("document_id", "path", "op", outcome.alias("outcome"))


def failures(outcomes: DataFrame) -> DataFrame:
    """Failed and checked expectations of each document and, with a null document_id, of all."""
    return outcomes.rollup("document_id").agg(F.count_if(F.col("outcome") != "pass").alias("n_failed"), F.count("*").alias("n_checked"))


# Phrases of a response's body and their classes, by status.
EDIT_CLASSES = {400: (("did not resolve", "WALK"), ("must be a number", "COERCE"), ("must be yes or no", "COERCE"), ("must be one of", "ENUM")), 500: (("render failed", "RENDER"),)}


def edit_class(status: Column, body: Column) -> Column:
    """PASS, WALK, COERCE, ENUM, RENDER or OTHER from a response."""
    found = F.when(status == 200, "PASS")
    for code, phrases in EDIT_CLASSES.items():
        for phrase, name in phrases:
            found = found.when((status == code) & F.contains(body, F.lit(phrase)), name)
    return found.otherwise("OTHER")


def audit_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy(edit_class(F.col("status"), F.col("body")).alias("class")).agg(F.count("*").alias("n"))


def first_of_each(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place`` from 1 and the number of the ``rest``.

    Spark keeps k rows of a group in each task before the shuffle; the rest is counted apart, by sums.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    top = rows.withColumn("place", place).where(F.col("place") <= k)
    sizes = rows.groupBy(*by).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("rest"))
    met = sizes.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return top.join(met, same).drop(*[f"_{c}" for c in by])


def unknown_members(used: DataFrame, master: DataFrame) -> DataFrame:
    """Different members in use that the master list doesn't have, however often it has others."""
    return used.select("member").where("member is not null").distinct().join(master.select("member"), "member", "left_anti")


def first_seen(paths: DataFrame) -> DataFrame:
    """Different templates of (pos, path) in the order of their first place."""
    return paths.groupBy(S.path_template(F.col("path")).alias("template")).agg(F.min("pos").alias("first_pos"))


def confidence_histogram(leaf_table: DataFrame) -> DataFrame:
    level = lambda x: F.count_if(F.coalesce("confidence", F.lit("low")) == x).alias(f"n_{x}")
    return leaf_table.groupBy("report_id").agg(level("high"), level("medium"), level("low"))


def issue_buckets(issues: DataFrame) -> DataFrame:
    bucket = F.when(F.col("kind") == "MissingRequiredField", "Missing").when(F.col("kind") == "ManualReviewRequired", "Needs review").otherwise("Other")
    return issues.groupBy("report_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
