"""Event-sourced edits: the current state is a fold of the edits so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckoner.functions import scalars as S


def current(edits: DataFrame) -> DataFrame:
    """Latest text of every (report, path); ties in time go to the larger event."""
    return edits.groupBy("report_id", "path").agg(F.max_by("new_text", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("changed_at"), F.count("*").alias("n_edits"))


def history(edits: DataFrame, cap: int = 20) -> DataFrame:
    """The newest ``cap`` edits of each report, 1 being the newest."""
    newest = Window.partitionBy("report_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return edits.withColumn("age", F.row_number().over(newest).cast("long")).where(F.col("age") <= cap)


def undone(edits: DataFrame) -> DataFrame:
    """Per report: its newest edit, and the value that undoing it restores (null: none)."""
    by_path = Window.partitionBy("report_id", "path").orderBy("ts", "event_id")
    before = edits.withColumn("old_text", F.lag("new_text").over(by_path))
    return before.groupBy("report_id").agg(F.max_by(F.struct("path", "new_text", "old_text", "event_id"), F.struct("ts", "event_id")).alias("e")).select("report_id", "e.path", "e.new_text", "e.old_text", "e.event_id")


def applied(edits: DataFrame, leaves: DataFrame, field_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves after the edits, rejected edits with a reason).

    ``leaves``: report_id, path, value and, if its type is known, kind ("boolean", "number"
    or "string"; null for null), which decides before the catalogue; ``field_types``:
    template, type, allowed (array or null). A missing leaf is made only if the catalogue
    knows its template and the object that it would stand in is there: a line that isn't
    there gets no fields. All edits are judged against ``leaves``; ``replay`` judges each
    against the state after the one before.
    """
    types = field_types.withColumnRenamed("template", "_template")
    old = F.when(F.col("value") != "", F.col("kind")) if "kind" in leaves.columns else F.lit(None).cast("string")
    known = leaves.select("report_id", "path", F.lit(True).alias("_there"), old.alias("_kind"))
    # The catalogue is joined as Spark chooses: it checks its size.
    e = edits.withColumn("_template", S.path_template(F.col("path"))).join(types, "_template", "left").join(known, ["report_id", "path"], "left")
    parts = F.split("path", r"\.")
    objects = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    around = leaves.select("report_id", F.explode(objects).alias("_parent")).distinct().withColumn("_around", F.lit(True))
    e = e.withColumn("_parent", F.regexp_extract("path", r"(?s)^(.*)\.[^.]*\z", 1)).join(around, ["report_id", "_parent"], "left")
    no_place = F.col("_there").isNull() & F.col("_around").isNull() & (F.col("_parent") != "expense_report")
    coerced = S.coerce_by_type(F.col("new_text"), F.col("type"), F.col("_kind"))
    reason = (
        F.when(~F.col("path").startswith("expense_report."), "path must start with expense_report")
        .when(S.path_steps(F.col("path")).isNull(), "malformed path")
        .when((F.col("_there").isNull() & F.col("type").isNull()) | no_place, "unknown path")
        .when(coerced["error"], "value has the wrong type")
        .otherwise(F.when(F.col("allowed").isNotNull(), S.validate_enum(coerced["value"], F.col("allowed"))))
    )
    judged = e.withColumns({"reason": reason, "coerced": coerced["value"]})
    good = judged.where("reason is null").groupBy("report_id", "path").agg(F.max_by("coerced", F.struct("ts", "event_id")).alias("new"), F.lit(True).alias("edited"))
    after = leaves.join(good, ["report_id", "path"], "full_outer")
    after = after.select("report_id", "path", F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("edited", F.lit(False)).alias("edited"))
    return after, judged.where("reason is not null").select("report_id", "path", "new_text", "reason")


def with_meta(after: DataFrame) -> DataFrame:
    """``after`` (from ``applied``) with ``meta``: an edit keeps the metadata that a leaf has, and a
    leaf that it makes is of high confidence and says that a user wrote it."""
    evidence = F.array(F.struct(F.lit("user_input").alias("kind")))
    made = F.struct(F.lit("high").alias("confidence"), evidence.alias("evidence"), F.lit(False).alias("needs_review"))
    meta = F.col("meta") if "meta" in after.columns else F.when(F.lit(False), made)
    return after.withColumn("meta", F.coalesce(meta, F.when(F.col("edited"), made)))


def delete_lines(lines: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines without the deleted ones and indexes closed up, deletions out of range)."""
    keys = deleted.select("report_id", "line_idx").distinct()
    left = lines.join(keys, ["report_id", "line_idx"], "left_anti")
    at = Window.partitionBy("report_id").orderBy("line_idx")
    return left.withColumn("line_idx", F.row_number().over(at).cast("long") - 1), keys.join(lines, ["report_id", "line_idx"], "left_anti")


def summaries(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals and earliest dates after edits; old ones stay where there are no values."""
    per = lines.groupBy("report_id").agg(F.round(F.sum(F.col("amount_usd").cast("decimal(24,6)")), 2).cast("double").alias("_total"), F.min("date_text").alias("_first"))
    joined = reports.join(per, "report_id", "left")
    return joined.withColumns({"total_usd": F.coalesce("_total", "total_usd"), "earliest_date": F.coalesce("_first", "earliest_date")}).drop("_total", "_first")
