"""Streaming forms: live job state, and receipts that arrive in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def job_state(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Latest phase of each job of a stream (job_id, phase, ts, event_id); update mode."""
    return events.withWatermark("ts", watermark).groupBy("job_id").agg(F.max_by("phase", F.struct("ts", "event_id")).alias("phase"), F.max("ts").alias("updated_at"), F.count("*").alias("n_updates"))


def log_durations(log: DataFrame, within: str = "1 hour") -> DataFrame:
    """Starts of a log stream joined with their ends, both watermarked."""
    key = ["label", "filename"]
    start = log.where("event = 'subprocess.start'").select(*key, F.col("ts").alias("started_at")).withWatermark("started_at", within)
    end = log.where("event in ('subprocess.done', 'subprocess.fail')").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("ts").alias("ended_at"), "event").withWatermark("ended_at", within)
    met = (F.col("label") == F.col("_label")) & (F.col("filename") == F.col("_filename")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    return start.join(end, met).select(*key, "started_at", "ended_at", "event")


def rereduce(receipts: DataFrame, store: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], reduce_lines: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Each batch of new receipts replaces those with the same stem, and its reports are
    reduced again; ``save`` writes them, so a repeated batch gives the same store."""
    from reckoner.operators.store import add_receipts

    def batch(new: DataFrame, number: int) -> None:
        touched = new.select("report_id").distinct()
        old = store().join(touched, "report_id", "left_semi")
        save(reduce_lines(add_receipts(old, new)), number)

    return receipts.writeStream.foreachBatch(batch)
