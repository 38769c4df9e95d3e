"""What the training-data operators share: tables, the shared folder, packed arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows that ``with_results`` computes at a time.
PART_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes that ``light_batches`` sends at a time.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so fewer of them than by Spark's default go to a Python worker at once.

    A number that somebody has set stays.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(PART_ROWS))


def light_batches(spark: SparkSession) -> None:
    """At most ``BATCH_BYTES`` go to a Python worker at once, be they few long rows or many short ones.

    A limit that somebody has set stays.
    """
    if spark.conf.get(_BYTES, None) == "67108864b":
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session of one machine (as in tests) gets a temporary
    folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="reckoner-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later reads don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names would clash with an operator's results."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def with_results(
    df: DataFrame,
    work: Callable[[], Callable[[pa.Array], dict[str, object]]],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) and new ones computed from ``text``.

    ``work`` runs once in each task and returns the function that turns an Arrow
    column into the new columns by name. Nothing is shuffled. Columns of ``df``
    that carry the name of a new one give way to it. The session's Arrow batches become
    smaller, where they have Spark's default.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    names = [f.name for f in new]
    read = without(df, *names)
    kept = [c for c in read.columns if keep is None or c in keep]
    out = T.StructType([read.schema[c] for c in kept] + list(new))
    arrow = to_arrow_schema(out)
    needed = kept if text in kept else [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for whole in batches:
            # In parts, so that a worker holds the results of few texts.
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                found = compute(batch.column(needed.index(text)))
                columns = [batch.column(i) for i in range(len(kept))] + [found[n] for n in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c).cast(f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return read.select(*needed).mapInArrow(run, out)
