"""Language-model scores by prediction by partial matching over bytes.

A text is read as its lower-cased words, one space between them and an end symbol
(byte 0xFF, which UTF-8 never has) that also stands in front of the text. The model
is a trie of byte contexts of up to ``ORDER`` bytes, pretrained on the training
documents. A byte is looked for in the longest context known; where it is missing, an
escape (as likely as ``DISCOUNT`` of a count for each different byte seen there, which
these bytes lose) leads to the context shorter by a byte, in which all bytes of the longer
one are excluded; below order 0 all bytes not yet excluded are equally likely. The code lengths
of a document's bytes add up to its score.

The trie is static, so the bytes of a context include those of every longer one
that ends with it, and what an exclusion leaves is a property of the longer
context. It is computed with the model, and documents are scored by array lookups, a
slice of many documents at once.

Counting covers all training documents: slices of documents give the numbers of
their words and of their runs of ``ORDER`` + 1 bytes, tasks add up those of some slices, and Spark adds them all up; shorter
runs are marginals of these. No run is left out: the counts stay a Spark table, dealt
by the last ``LOW`` bytes of the contexts. All longer contexts of a byte end with these, so
each part of the table is a trie of its own above the shorter runs, which are
broadcast (there are 256 ** (LOW + 1) different ones at most, whatever the corpus).

The codes of runs that make up at least ``HOT_RUN_SHARE`` of all bytes (a larger share
where that gives more than ``HOT_RUNS``), and the counts of words that make up at least
``HOT_SHARE`` of all words, are broadcast. So the driver holds at most 256 ** LOW low runs
(268 MB; valid UTF-8 has far fewer), HOT_RUNS codes (32 MB) and 1 / HOT_SHARE words (16 MB),
as two arrays each, whatever the corpus; scores don't depend on what is hot. The other runs and words of a document are sent to the part of the
table that knows them, and what it answers is summed by row. The base score needs the count of
each word of a document among all training words. Sums are of whole ``UNIT`` ths, so they
don't depend on the order of their terms.

Defined results: null and wordless texts are scored for their end alone; a null
doc_id belongs to the training part; rows with equal doc_id and text have equal scores;
extra columns are not read; without training text the model is uniform and
train_tokens 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reckoner.llm import words
from reckoner.llm.common import fresh_path, light_batches

ORDER = 5
DISCOUNT = 0.4
LOW = 3
HOT_RUN_SHARE, HOT_RUNS = 1e-7, 2_000_000
HOT_SHARE = 1e-6
UNIT = 1 << 32
PART_ROWS = 1 << 20
#: Work on a slice takes some 60 times its size.
SLICE_BYTES = 1 << 20
#: Counts of slices that a task adds up before it hands them on, and rows of a batch handed on.
MERGED_ROWS = 1 << 20
OUT_ROWS = 1 << 16
END = 0xFF
_SPACE = 0x20


def normal(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model reads of each row, and where the rows begin.

    Words with a space between them, then the end.
    """
    size = w.ends - w.starts + 1
    at = np.cumsum(size) - size
    n_words = w.counts()
    rows = np.concatenate([[0], np.cumsum(size)])[w.first]
    empty = n_words == 0
    begin = rows + np.concatenate([[0], np.cumsum(empty)])
    out = np.full(int(begin[-1]), _SPACE, np.uint8)
    shift = np.repeat(np.cumsum(empty) - empty, n_words)
    body = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    out[body + np.repeat(at + shift, size - 1)] = w.data[body + np.repeat(w.starts, size - 1)]
    out[begin[1:] - 1] = END
    return out, begin


def runs(text: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` bytes in front as one number; ends pad."""
    within = np.arange(len(text)) - np.repeat(begin[:-1], np.diff(begin))
    key = text.astype(np.uint64)
    for k in range(1, order + 1):
        before = np.full(len(text), END, np.uint64)
        before[k:] = text[:-k] if k < len(text) else text[:0]
        before[within < k] = END
        key |= before << np.uint64(8 * k)
    return key


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is there."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.concatenate([at, [len(keys)]]))


class Model:
    """Code lengths by a trie, given the (run, count) tables of each order.

    Kept for each order: the sorted runs with the log10 probability of their last
    byte in the context of the others, the sorted contexts, and for escapes from a
    context the log10 of the escape and of what its exclusion leaves below.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.levels, low = [], None
        for o, (keys, counts) in enumerate(tables):
            counts = counts.astype(float)
            contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
            kept = np.bincount(place, weights=counts, minlength=len(contexts))
            types = np.bincount(place, minlength=len(contexts)).astype(float)
            if o:
                # How often the context was seen at all; more than what was kept below it.
                seen = _find(tables[o - 1][0], contexts)
                total = np.maximum(kept, np.where(seen >= 0, tables[o - 1][1][seen], 0))
            else:
                total = kept
            level = {"contexts": contexts, "keys": keys, "raw": counts, "total": total, "types": types, "pruned": total - kept}
            if low is None:
                mass, on = 256.0 - types, None
            else:
                parent = np.searchsorted(low["contexts"], contexts & np.uint64((1 << 8 * (o - 1)) - 1))
                child = np.searchsorted(low["keys"], keys & np.uint64((1 << 8 * o) - 1))
                left_types = low["types"][parent] - types
                gone = np.bincount(place, weights=low["raw"][child], minlength=len(contexts))
                mass = low["total"][parent] - gone
                on = DISCOUNT * left_types + low["pruned"][parent]
            with np.errstate(divide="ignore", invalid="ignore"):
                level["count"] = np.log10(counts - DISCOUNT)
                level["direct"] = level["count"] - np.log10(total)[place]
                level["escape"] = np.log10((DISCOUNT * types + total - kept) / total)
                level["mass"] = np.log10(mass)
                # Where the exclusion leaves nothing below, escaping on is certain.
                level["on"] = None if on is None else np.where(mass > 0, np.log10(on / mass), 0.0)
            self.levels.append(level)
            low = level
        self.order = len(tables) - 1

    def code(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run, given those before it."""
        out = np.zeros(len(key))
        if not len(self.levels[0]["keys"]):
            return out - math.log10(256)
        left = np.arange(len(key))
        # Escaped rows carry the place of the context that they come from.
        came = np.full(len(key), -1)
        for o in range(self.order, -1, -1):
            v = self.levels[o]
            k = key[left] & np.uint64((1 << 8 * (o + 1)) - 1)
            found = _find(v["keys"], k)
            hit, miss = found >= 0, found < 0
            from_above = came >= 0
            above = self.levels[o + 1] if o < self.order else None
            a = hit & ~from_above
            out[left[a]] += v["direct"][found[a]]
            a = hit & from_above
            if a.any():
                out[left[a]] += v["count"][found[a]] - above["mass"][came[a]]
            k, left_, came_ = k[miss], left[miss], came[miss]
            context = _find(v["contexts"], k >> np.uint64(8))
            first = (context >= 0) & (came_ < 0)
            out[left_[first]] += v["escape"][context[first]]
            again = came_ >= 0
            if again.any():
                out[left_[again]] += above["on"][came_[again]]
            left, came = left_, np.where(context >= 0, context, -1)
        known = came >= 0
        low = self.levels[0]
        out[left[known]] -= low["mass"][came[known]]
        out[left[~known]] -= math.log10(256)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


#: Kinds of rows, in the order in which a part reads them: counts before questions.
_RUN, _WORD, _ASK_RUN, _ASK_WORD, _DOC = range(5)


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of (key, count) tables, each in order of its keys."""
    keys, counts = (np.concatenate(x) for x in zip(*tables, strict=True))
    # Stable, as that is fast on runs already in order.
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, count) of the runs and words of slices, added up as far as ``MERGED_ROWS`` goes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {_RUN: [], _WORD: []}

    def told(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        # In parts, as the JVM holds each whole outside its heap.
        for at in range(0, len(keys), OUT_ROWS):
            k, c = keys[at : at + OUT_ROWS], counts[at : at + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "count"])

    for batch in batches:
        data, offsets = words.utf8(batch.column(0))
        for a, b in words.slices(offsets, SLICE_BYTES):
            w = words.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            text, begin = normal(w)
            for kind, keys in ((_RUN, runs(text, begin, ORDER)), (_WORD, w.hashes())):
                held[kind].append(counted(keys))
                if sum(len(k) for k, _ in held[kind]) > MERGED_ROWS:
                    held[kind] = [_added(held[kind])]
                    # Where little falls together, no more is kept.
                    if len(held[kind][0][0]) > MERGED_ROWS // 2:
                        yield from told(kind, *held[kind].pop())
    for kind, tables in held.items():
        if tables:
            yield from told(kind, *_added(tables))


class Fitted:
    """What scoring needs: the low orders, the hot runs and words, and the totals of words."""

    def __init__(self, low: list[tuple[np.ndarray, np.ndarray]], hot: np.ndarray, hot_counts: np.ndarray, n: int, distinct: int, ends: int, parts: int):
        self.low, self.hot, self.n, self.distinct, self.ends, self.parts = low, hot, n, distinct, ends, parts
        self.hot_code = _units(np.log10(hot_counts + 0.5))
        self.runs, self.run_code = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _arrays(df: DataFrame, value: str = "count") -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", value).toArrow()
    keys = got.column(0).to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], got.column(1).to_numpy()[by]


def _masked(key: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The marginal counts of the runs of ``order`` + 1 bytes."""
    short, place = np.unique(key & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return short, np.bincount(place, weights=counts, minlength=len(short)).astype(np.int64)


def _answered(counts: DataFrame, asked: DataFrame, fitted: Fitted) -> DataFrame:
    """(row, doc, score, cold_n, cold_sum): the answers to rows of ``asked``, to be summed by row.

    ``asked``: kind, row, key, n (how often the row has the key) and doc, which passes through.
    """
    shared = counts.sparkSession.sparkContext.broadcast(fitted.low)
    doc_type = asked.schema["doc"].dataType
    out = T.StructType.fromDDL(f"row long, doc {doc_type.simpleString()}, score long, cold_n long, cold_sum long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, words_of = {_RUN: [], _WORD: []}, None, None
        for batch in batches:
            kind, key = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            row, n = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for k, got in known.items():
                if (kind == k).any():
                    got.append((key[kind == k].copy(), n[kind == k].copy()))
            if not (kind >= _ASK_RUN).any():
                continue
            if model is None:
                joined = {}
                for k, got in known.items():
                    keys, counts_ = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64)))
                    by = np.argsort(keys)
                    joined[k] = keys[by], counts_[by]
                model = Model([*shared.value, *(_masked(*joined[_RUN], o) for o in range(LOW, ORDER + 1))])
                words_of = joined[_WORD]
            ask = (kind == _ASK_RUN) | (kind == _ASK_WORD)
            if ask.any():
                who, place = np.unique(row[ask].astype(np.int64), return_inverse=True)
                run_code, word_n, word_code = (np.zeros(len(ask), np.int64) for _ in range(3))
                at = np.flatnonzero(kind == _ASK_RUN)
                distinct, back = np.unique(key[at], return_inverse=True)
                run_code[at] = n[at] * _units(model.code(distinct))[back]
                at = np.flatnonzero(kind == _ASK_WORD)
                found = _find(words_of[0], key[at])
                seen = np.zeros(len(at), np.int64)
                seen[found >= 0] = words_of[1][found[found >= 0]]
                word_n[at], word_code[at] = n[at] * (seen > 0), n[at] * _units(np.log10(seen + 0.5))
                sums = []
                for values in (run_code, word_n, word_code):
                    total = np.zeros(len(who), np.int64)
                    np.add.at(total, place, values[ask])
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), arrow.field("doc").type), *sums], schema=arrow)
            docs = np.flatnonzero(kind == _DOC)
            if len(docs):
                zero = pa.array(np.zeros(len(docs), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(row[docs].astype(np.int64)), batch.column(4).take(pa.array(docs)).cast(arrow.field("doc").type), zero, zero, zero], schema=arrow)

    trained = counts.select("kind", F.lit(0).cast("long").alias("row"), "key", F.col("count").alias("n"), F.lit(None).cast(doc_type).alias("doc"))
    is_run = F.col("kind").isin(_RUN, _ASK_RUN)
    group = F.when(is_run, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))).otherwise(F.col("key"))
    dealt = trained.unionByName(asked).repartition(fitted.parts, group).sortWithinPartitions("kind")
    return dealt.mapInArrow(run, out)


def fit(training: DataFrame) -> tuple[Fitted, DataFrame]:
    """The fitted model, and the counts of all training runs and words (kind, key, count)."""
    spark = training.sparkSession
    light_batches(spark)
    path = fresh_path(spark, "ppm")
    each = training.select("text").mapInArrow(_count, "kind int, key long, count long")
    each.groupBy("kind", "key").agg(F.sum("count").alias("count")).write.parquet(path)
    table = spark.read.parquet(path)
    ends = training.count()
    of = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("count").alias("n"), F.count("*").alias("distinct")).collect()}
    n_bytes, n_runs = (of[_RUN]["n"], of[_RUN]["distinct"]) if _RUN in of else (0, 0)
    n_words, distinct = (of[_WORD]["n"], of[_WORD]["distinct"]) if _WORD in of else (0, 0)
    low = []
    for o in range(LOW):
        key = F.col("key").bitwiseAND(F.lit((1 << 8 * (o + 1)) - 1))
        low.append(_arrays(table.where(F.col("kind") == _RUN).groupBy(key.alias("key")).agg(F.sum("count").alias("count"))))
    hot, hot_counts = _arrays(table.where((F.col("kind") == _WORD) & (F.col("count") >= max(2, math.ceil(HOT_SHARE * n_words)))))
    hot_runs = table.where((F.col("kind") == _RUN) & (F.col("count") >= max(2, math.ceil(HOT_RUN_SHARE * n_bytes))))
    # At most 64 rows: how many of these runs have counts between powers of two.
    by_size = {r["power"]: r["count"] for r in hot_runs.groupBy(F.floor(F.log2("count")).alias("power")).count().collect()}
    if sum(by_size.values()) > HOT_RUNS:
        power = next(p for p in range(65) if sum(n for q, n in by_size.items() if q >= p) <= HOT_RUNS)
        hot_runs = hot_runs.where(F.floor(F.log2("count")) >= power)
    hot_bytes = hot_runs.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
    # Enough parts for the counts and for what the training documents themselves would ask.
    rows = n_runs + distinct + n_bytes - hot_bytes + n_words - int(hot_counts.sum())
    fitted = Fitted(low, hot, hot_counts, n_words + ends, distinct + (ends > 0), ends, max(spark.sparkContext.defaultParallelism, math.ceil(rows / PART_ROWS)))
    asked = hot_runs.select(F.lit(_ASK_RUN).alias("kind"), F.col("key").alias("row"), "key", F.lit(1).cast("long").alias("n"), F.lit(None).cast("struct<doc_id: long>").alias("doc"))
    fitted.runs, fitted.run_code = _arrays(_answered(table, asked, fitted).select(F.col("row").alias("key"), "score"), "score")
    return fitted, table


def _score_slice(fitted: Fitted, w: words.Words) -> tuple[np.ndarray, ...]:
    """Per row the hot sums; and the (row, run, times) and (row, word, times) of cold ones."""
    n_rows = len(w.first) - 1
    text, begin = normal(w)
    key = runs(text, begin, ORDER)
    place = np.argsort(key)
    key = key[place]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct, back = key[new], np.cumsum(new) - 1
    at = _find(fitted.runs, distinct)
    codes = np.zeros(len(distinct), np.int64)
    codes[at >= 0] = fitted.run_code[at[at >= 0]]
    code = np.zeros(len(key), np.int64)
    code[place] = codes[back]
    score = np.add.reduceat(code, begin[:-1]) if n_rows else code
    cold = np.flatnonzero((at < 0)[back])
    both, run_times = np.unique(back[cold] * max(1, n_rows) + np.searchsorted(begin, place[cold], "right") - 1, return_counts=True)
    of_runs = both % max(1, n_rows), distinct[both // max(1, n_rows)], run_times
    hashed, row = w.hashes(), np.repeat(np.arange(n_rows), w.counts())
    at = _find(fitted.hot, hashed)
    is_hot = at >= 0
    hot_sum = np.zeros(n_rows, np.int64)
    np.add.at(hot_sum, row[is_hot], fitted.hot_code[at[is_hot]])
    hot_n = np.bincount(row[is_hot], minlength=n_rows)
    cold, cold_row = hashed[~is_hot], row[~is_hot]
    by = np.lexsort((cold, cold_row))
    cold, cold_row = cold[by], cold_row[by]
    first = np.flatnonzero(np.concatenate([[True], (cold[1:] != cold[:-1]) | (cold_row[1:] != cold_row[:-1])])) if len(cold) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(cold)]]))
    return score, hot_sum, hot_n, of_runs, (cold_row[first], cold[first], times)


def score(docs: DataFrame, fitted: Fitted, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; no rows
    for no documents."""
    light_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    doc = f"struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, n_tokens: long, hot_n: long, hot_sum: long, score: long>"
    schema = T.StructType.fromDDL(f"kind int, row long, key long, n long, doc {doc}")
    arrow = to_arrow_schema(schema)
    fields = list(arrow.field("doc").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit_, part, seen = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for a, b in words.slices(offsets, SLICE_BYTES):
                w = words.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score_, hot_sum, hot_n, of_runs, of_words = _score_slice(fit_, w)
                n = b - a
                name = (part << 36) + seen + np.arange(n)
                seen += n
                for kind, (row, key, times) in ((_ASK_RUN, of_runs), (_ASK_WORD, of_words)):
                    for at in range(0, len(row), OUT_ROWS):
                        part_of = slice(at, at + OUT_ROWS)
                        columns = [np.full(len(row[part_of]), kind, np.int32), name[row[part_of]], key[part_of].view(np.int64), times[part_of].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(row[part_of]), arrow.field("doc").type)], schema=arrow)
                # A row of its own for each document.
                own = [batch.column(0).slice(a, n).cast(fields[0].type), *(pa.array(x.astype(np.int64)) for x in (w.counts() + 1, hot_n, hot_sum, score_))]
                columns = [np.full(n, _DOC, np.int32), name, words.mix(name.astype(np.uint64)).view(np.int64), np.ones(n, np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.StructArray.from_arrays(own, fields=fields)], schema=arrow)

    each = docs.select("doc_id", "text").mapInArrow(run, schema)
    met = _answered(counts, each, fitted).groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"),
        F.max("doc.n_tokens").alias("n_tokens"),
        F.max("doc.hot_n").alias("hot_n"),
        (F.max("doc.hot_sum") + F.sum("cold_sum")).alias("sum"),
        (F.max("doc.score") + F.sum("score")).alias("score"),
        F.sum("cold_n").alias("cold_n"),
    )
    # The end is a token like any other.
    base = F.col("sum") / F.lit(UNIT) + F.lit(math.log10(fitted.ends + 0.5))
    each_token = math.log10(fitted.n + 0.5 * (fitted.distinct + 1))
    return met.select(
        "doc_id",
        "n_tokens",
        (F.col("hot_n") + F.col("cold_n") + F.lit(int(fitted.ends > 0))).alias("n_known"),
        F.lit(fitted.n).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(each_token)).alias("base_score"),
        (F.col("score") / F.lit(UNIT)).alias("score"),
    )
