"""A table kept as numbered batches, so that a batch that comes again changes nothing.

Batch n is a folder of its own with all rows of the keys that it touched. The table as of n
has, for each key, the rows of its newest batch up to n. Work on batch n reads the table
as of n - 1 and replaces folder n, so if it fails half-way, or its end isn't recorded and
it is repeated, the outcome is the same. Readers see only folders whose write was
committed. Every ``every`` batches a folder holds the whole table, and readers begin there.

Defined results: a key that a batch touches and leaves no row of is gone from there on,
as the batch's folder says so; rows with a null key form a key; no batches give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reckoner.operators.store import add_receipts
from reckoner.sources.readers import line_index


class Versions:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, every: int = 50):
        self.spark, self.path, self.key, self.schema, self.every = spark, path.rstrip("/"), key, schema, every

    def _numbers(self, kind: str) -> list[int]:
        """Committed folders of a kind, by number."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [s.getPath() for s in system.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def at(self, n: int | None = None, without: int | None = None) -> DataFrame:
        """The rows as of batch ``n`` (by default the newest), not from the whole table ``without``."""
        within = lambda k: n is None or k <= n
        whole = max((k for k in self._numbers("whole") if within(k) and k != without), default=-1)
        kind = self.spark.createDataFrame([], f"{self.schema}, _gone boolean").schema
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/whole={whole}").withColumn("_batch", F.lit(whole))] if whole >= 0 else []
        parts += [self.spark.read.schema(kind).parquet(f"{self.path}/batch={k}").withColumn("_batch", F.lit(k)) for k in self._numbers("batch") if whole < k and within(k)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        newest = every.groupBy(F.col(self.key).alias("_key")).agg(F.max("_batch").alias("_newest"))
        met = every.join(newest, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_batch") == F.col("_newest")), "left_semi")
        return met.where("not _gone").drop("_gone", "_batch")

    def put(self, rows: DataFrame, touched: DataFrame, n: int) -> None:
        """Batch ``n``: the ``rows`` of the keys in ``touched``; keys without a row are gone."""
        shown = rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema])
        gone = touched.select(self.key).distinct().join(shown.select(F.col(self.key).alias("_key")), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        both = shown.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        if n and n % self.every == 0:
            # A repeated batch replaces the whole table that it may have written before.
            self.at(n, without=n).withColumn("_gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/whole={n}")


def rereduce(new: DataFrame, receipts: Versions, reports: Versions, reduce_lines: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A stream of receipts (report_id, source_filename, ...) kept in ``receipts``, and the reports it touches in ``reports``.

    A receipt replaces that of the same report whose name has the same stem. Touched reports
    are reduced again, by ``reduce_lines`` from their lines (with line_idx, in the order of names); what it
    returns has no history, so edits made before are cleared.
    """

    def batch(rows: DataFrame, n: int) -> None:
        touched = rows.select("report_id").distinct().persist()
        rows = rows.dropDuplicates(["report_id", "source_filename"])
        old = receipts.at(n - 1)
        old = old.join(touched.select(F.col("report_id").alias("_id")), F.col("report_id").eqNullSafe(F.col("_id")), "left_semi")
        receipts.put(add_receipts(old, rows.select(*old.columns)), touched, n)
        # From what was written: the lines aren't computed a second time.
        now = receipts.at(n)
        now = now.join(touched.select(F.col("report_id").alias("_id")), F.col("report_id").eqNullSafe(F.col("_id")), "left_semi")
        reports.put(reduce_lines(line_index(now.withColumn("file_name", F.col("source_filename"))).drop("file_name")), touched, n)
        touched.unpersist()

    return new.writeStream.foreachBatch(batch)
