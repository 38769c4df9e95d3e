"""Hard negatives by slots between positives.

A row's score is its integer inner product with the anchor. A positive of score p takes
the first ``k`` rows of other labels whose score is between ``low`` percent of p and p. The
windows of an anchor's positives overlap. So their upper limits cut the scores into
disjoint slots: a slot holds what is at most its own limit and above the next one. Each
task keeps the best k rows of every slot it has seen, the same is done again where a slot's
rows meet, and then a window is the beginning of the merged slots from its own downwards,
as far as its lower limit: the best k at or below a limit are among the best k of
the slots there.

Anchors are taken in blocks of ``BLOCK`` rows, each sent to every task, and held against all
rows, ``ROWS`` at a time, as products of matrices. Rows are dealt once by ranges of (label,
hash of the id), so a large label is in many tasks, and written compactly. Products are
exact: in 32 bits where the lengths of the vectors show that no sum reaches 2^24, in 64
bits below 2^53, else as Python integers, held to the range of a long.

1. Positives: each task keeps an anchor's best rows of its label; merged, the first 5 stay.
2. Negatives: rows of other labels between the lowest lower and the highest upper limit
   go to their slot.

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part; a missing component counts as 0; several rows with one id are rows of
their own, and the anchor itself (one row of its id, label and vector) is no partner of its
own; equal anchor rows are answered once; a positive's score below 0 has an empty window; extra
columns aren't read; no rows or no anchors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckoner.llm.common import fresh_path, settled, small_batches

SCALE, POSITIVES, NEGATIVES, LOW = 256, 5, 5, 80
#: Anchors held against the rows at a time, and rows.
BLOCK, ROWS = 8192, 256
#: Candidates that a task gathers before it drops all but the best.
GATHERED = 1 << 19


def padded(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """A row for each vector: the components as whole numbers, in doubles."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    return padded(np.split(flat, np.cumsum(sizes)[:-1]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, as floats or longs."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    # No partial sum is larger than the product of the lengths.
    most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if most < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**53:
        return a @ b.T
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a], object)
    return np.clip(exact.reshape(len(a), len(b)), 1 - 2**63, 2**63 - 1).astype(np.int64)


def below(limits: np.ndarray, kind: np.dtype) -> np.ndarray:
    """``limits`` in another type of number, none of them larger than it was."""
    return limits if kind == np.int64 else np.nextafter(limits.astype(kind), kind.type(-np.inf))


def above(limits: np.ndarray, kind: np.dtype) -> np.ndarray:
    return -below(-limits, kind)


class Best:
    """The best ``k`` rows of each key seen so far: highest score, then smallest id."""

    def __init__(self, n_keys: int, k: int):
        self.k = k
        self.least = np.full(n_keys, np.iinfo(np.int64).min)
        self.held = [np.zeros(0, np.int64)] * 3
        self.new: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        # What is below a key's k-th row so far can't come in.
        use = scores >= self.least[keys]
        self.new.append([keys[use], scores[use], ids[use]])
        self.size += int(use.sum())
        if self.size > GATHERED:
            self.shrink()

    def shrink(self) -> None:
        keys, scores, ids = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        begins = np.searchsorted(keys, keys)
        rank = np.arange(len(keys)) - begins
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[keys[full]] = scores[full]
        self.held, self.new, self.size = [keys[keep], scores[keep], ids[keep]], [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.shrink()
        return tuple(self.held)


def prepared(rows: DataFrame, anchor: Column, vector: str = "vector") -> DataFrame:
    """id, label, vector and anchor of the rows that take part, dealt by label and id."""
    small_batches(rows.sparkSession)
    kind = rows.schema[vector].dataType.simpleString()
    value = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    out = rows.select(F.col("vec_id").alias("id"), "label", value.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    # Comparison with a null or not a number isn't true in any of these.
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False)) & ~F.isnan(x))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    path = fresh_path(rows.sparkSession, "negatives")
    out.repartitionByRange("label", F.xxhash64("id")).sortWithinPartitions("label", "id").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def blocks(rows: DataFrame, size: int = BLOCK) -> Iterator[pa.Table]:
    """The different anchors, at most ``size`` of them at a time."""
    each = settled(rows.where("anchor").select("id", "label", "vector").distinct())
    parts = 1 + each.count() // (4 * size)
    # Numbers of rows in a written table don't change.
    each = settled(each.repartition(parts)).withColumn("_at", F.monotonically_increasing_id())
    each = each.withColumn("_block", F.struct(F.shiftright("_at", 33).alias("part"), F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / size).alias("nth")))
    for r in each.select("_block").distinct().sort("_block").collect():
        part, nth = r["_block"]
        yield each.where((F.col("_block.part") == part) & (F.col("_block.nth") == nth)).select("id", "label", "vector").toArrow()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of at most ``ROWS`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some.column("id").to_numpy(), np.array(some.column("label").to_pylist(), object), whole_numbers(some.column("vector"))


def _best_rows(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` rows of each key; Spark drops others before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def positives(rows: DataFrame, anchors: pa.Table, k: int) -> list[list[tuple[int, int]]]:
    """The best ``k`` (score, id) of each anchor's label, without the anchor itself."""
    matrix, ids = whole_numbers(anchors.column("vector").combine_chunks()), anchors.column("id").to_pylist()
    labels: dict[object, list[int]] = {}
    for i, label in enumerate(anchors.column("label").to_pylist()):
        labels.setdefault(label, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(matrix), k + 1)
        for row_ids, row_labels, vectors in _parts(batches):
            for label in set(row_labels) & set(labels):
                of, use = np.array(labels[label]), row_labels == label
                s = products(matrix[of], vectors[use])
                a, r = np.nonzero(s >= below(best.least[of], s.dtype)[:, None])
                best.add(of[a], s[a, r].astype(np.int64), row_ids[use][r])
        key, score, found = best.rows()
        yield pa.RecordBatch.from_pydict({"key": key, "score": score, "id": found})

    some = rows.where(F.col("label").isin(list(labels))).select("id", "label", "vector")
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    for key, score, found in _best_rows(some.mapInArrow(run, "key long, score long, id long"), k + 1, "key").collect():
        out[key].append((-score, found))
    own = [(-int(products(v[None], v[None])[0, 0]), i) for v, i in zip(matrix, ids, strict=True)]
    for have, x in zip(out, own, strict=True):
        have.sort()
        # A row with the anchor's id and its product with itself; which of them goes makes no difference.
        if x in have:
            have.remove(x)
    return [[(-s, i) for s, i in have[:k]] for have in out]


def negatives(rows: DataFrame, anchors: pa.Table, found: list[list[tuple[int, int]]], k: int, low: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores for the anchors of a block."""
    spark = rows.sparkSession
    use = [i for i, have in enumerate(found) if have and have[0][0] >= 0]
    anchors, found = anchors.take(pa.array(use, pa.int64())), [[(s, i, -(-low * s // 100)) for s, i in found[n] if s >= 0] for n in use]
    matrix, ids, labels = whole_numbers(anchors.column("vector").combine_chunks()), anchors.column("id").to_pylist(), anchors.column("label").to_pylist()
    width = max(map(len, found), default=1)
    none = np.iinfo(np.int64).min
    limits = np.full((len(found), width), none)
    for at, have in enumerate(found):
        cuts = sorted({s for s, _, _ in have}, reverse=True)
        limits[at, : len(cuts)] = cuts
    least = np.array([min(x[2] for x in have) for have in found], np.int64)
    codes: dict[object, int] = {}
    code = np.array([codes.setdefault(x, len(codes)) for x in labels], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(limits.size, k)
        for row_ids, row_labels, vectors in _parts(batches):
            s = products(matrix, vectors)
            other = code[:, None] != np.array([codes.get(x, -1) for x in row_labels])
            a, r = np.nonzero((s >= below(least, s.dtype)[:, None]) & (s <= above(limits[:, 0], s.dtype)[:, None]) & other)
            score = s[a, r].astype(np.int64)
            slot = (limits[a] >= score[:, None]).sum(1) - 1
            in_slot = (slot >= 0) & (score >= least[a])
            best.add((a * width + slot)[in_slot], score[in_slot], row_ids[r][in_slot])
        key, score, row = best.rows()
        yield pa.RecordBatch.from_pydict({"key": key // width, "slot": key % width, "score": score, "id": row})

    slots = _best_rows(rows.select("id", "label", "vector").mapInArrow(run, "key long, slot long, score long, id long"), k, "key", "slot")
    # All slots of an anchor, from the highest score down: at most k rows for each of its positives.
    merged = slots.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("have"))
    asked = [(at, ids[at], i, s, least) for at, have in enumerate(found) for s, i, least in have]
    windows = spark.createDataFrame(asked, "key long, anchor_id long, positive_id long, positive_score long, least long")
    inside = F.slice(F.filter("have", lambda x: (-x["minus"] <= F.col("positive_score")) & (-x["minus"] >= F.col("least"))), 1, k)
    out = merged.join(F.broadcast(windows), "key").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.minus")).alias("negative_score"))


def mine(rows: DataFrame, anchor: Column, vector: str = "vector", n_positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, block: int = BLOCK) -> DataFrame:
    """For each anchor of ``rows`` (vec_id, label and ``vector``) and each of its positives, its hard negatives.

    ``anchor`` says which rows are anchors.
    """
    dealt = prepared(rows, anchor, vector)
    path = fresh_path(rows.sparkSession, "hard-negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows.sparkSession.createDataFrame([], kind).write.parquet(path)
    for anchors in blocks(dealt, block):
        found = positives(dealt, anchors, n_positives)
        if any(have and have[0][0] >= 0 for have in found):
            negatives(dealt, anchors, found, k, low).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(kind).parquet(path)
