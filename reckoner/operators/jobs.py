"""Job state, log pairing and token usage, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error")
RETRYABLE_CODES = (408, 429, 500, 502, 503, 504)


def latest(events: DataFrame) -> DataFrame:
    """Latest phase of each job, with its first and last time and number of updates."""
    return events.groupBy("job_id").agg(F.max_by("phase", F.struct("ts", "event_id")).alias("phase"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_updates"))


def outcomes(events: DataFrame) -> DataFrame:
    """Finished and failed updates per job; failed only if every finished one failed."""
    n = lambda p: F.count_if(F.col("phase") == p)
    per = events.groupBy("job_id").agg(n("done").alias("n_done"), n("error").alias("n_failed"), F.count("*").alias("n_total"))
    return per.withColumn("all_failed", (F.col("n_done") == 0) & (F.col("n_failed") > 0))


def wall_clock(events: DataFrame) -> DataFrame:
    """Seconds from first to last update, and per update."""
    per = events.groupBy("job_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"), F.count("*").alias("n"))
    return per.select("job_id", "seconds", F.round(F.col("seconds") / F.greatest(F.lit(1), F.col("n")), 3).alias("seconds_per_update"))


def lost(uploads: DataFrame, jobs: DataFrame, now: Column, ticks: int = 20, tick_seconds: float = 0.5) -> DataFrame:
    """Uploads without job state for so long, and jobs without an upload."""
    j = uploads.join(jobs.select(F.col("job_id").alias("upload_id"), "phase"), "upload_id", "full_outer")
    age = F.unix_timestamp(now) - F.unix_timestamp("uploaded_at")
    state = F.when(F.col("uploaded_at").isNull(), "not_found").when(F.col("phase").isNotNull(), F.col("phase")).when(age >= ticks * tick_seconds, "lost").otherwise("pending")
    return j.select("upload_id", state.alias("state"))


def read_log(spark, path: str) -> DataFrame:
    """severity, event, ts and all fields as a variant of JSON-lines logs."""
    v = F.try_parse_json("value")
    raw = spark.read.text(path).select(v.alias("props")).where("props is not null")
    get = lambda name, kind: F.try_variant_get("props", f"$.{name}", kind)
    return raw.select(get("severity", "string").alias("severity"), get("event", "string").alias("event"), F.timestamp_seconds(get("timestamp", "double")).alias("ts"), "props")


def paired(log: DataFrame) -> DataFrame:
    """Starts (label, filename, event, ts) with the end that follows, by order of each label."""
    key = ["label", "filename"]
    at = lambda: Window.partitionBy(*key).orderBy("ts")
    start = log.where("event = 'subprocess.start'").withColumn("turn", F.row_number().over(at())).select(*key, "turn", F.col("ts").alias("started_at"))
    end = log.where("event in ('subprocess.done', 'subprocess.fail')").withColumn("turn", F.row_number().over(at())).select(*key, "turn", F.col("ts").alias("ended_at"), (F.col("event") == "subprocess.fail").alias("failed"))
    return start.join(end, [*key, "turn"], "left").withColumn("seconds", F.unix_timestamp("ended_at") - F.unix_timestamp("started_at"))


# Names of errors that may pass when a call is repeated, and of those that are
# special cases of a lost connection.
RETRYABLE_NAMES = ("TimeoutError", "ConnectionError", "ServiceUnavailable", "InternalServerError", "DeadlineExceeded", "GoogleAPIError", "RetryError")
CONNECTION_NAMES = ("BrokenPipeError", "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError", "RemoteDisconnected")


def is_retryable(code: Column, name: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE_CODES), F.lit(False)) | F.coalesce(name.isin(*RETRYABLE_NAMES, *CONNECTION_NAMES), F.lit(False))


def usage(log: DataFrame) -> DataFrame:
    """Token totals per document and call."""
    return log.groupBy("filename", "label").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n_calls"))
