"""Spelling variants by a dictionary of pairs of trie nodes.

Two words are near if one inserted, deleted or replaced code point makes one of the
other. Cut a word at a place: what stands before is a node of the trie of all words, what
stands behind is a node of the trie of all reversed words. With nodes as numbers,
near words are found by equality of pairs of integers:

* replaced: both words, each without its code point at the place, are the same pair
  (node before, node behind);
* inserted or deleted: the longer word without a code point is the same pair as the shorter
  one cut at that place. In a run of equal code points only the first is left out, so each
  two near words meet in exactly one pair.

Words of a pair differ in one code point at one place, so a group has at most one word for
each code point of the alphabet, and one shorter word, however many words there are. No
spelling is compared with another, and a word of length L makes 2 L + 1 rows of integers.

Numbers of nodes. Words are dealt by ranges, sorted, and written; each task then walks
through its range as through a trie: what a word shares with the one before keeps its
numbers, the rest gets new ones. A node whose words lie in several ranges is a beginning of
the first word of the later ones. Those nodes are numbered by these first words (one
a range, which the driver reads: as many as partitions), so every task gives them the same
number. Numbers of words follow the order of code points and break ties.

Defined results: null words are no words; a repeated word counts once, with the sum of
its n (null: 0); the empty word is near to all words of one code point; extra columns
aren't read; no words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reckoner.llm.common import settled

RATIO = 10
#: Bits for the nodes of a range.
_PART = 40
_SPLIT, _SKIP, _FIRST = 0, 1, 2


def common(a: str, b: str) -> int:
    """The length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _border(heads: list[str], at: int) -> np.ndarray:
    """Numbers of the beginnings of a range's first word, by the first range that has them in it."""
    word, shared = heads[at], len(heads[at])
    first = np.full(shared + 1, at, np.int64)
    for j in range(at - 1, -1, -1):
        shared = min(shared, common(heads[j], word))
        first[: shared + 1] = j
        if not shared:
            first[0] = 0
            break
    return -1 - ((first << 32) + np.arange(len(first)))


def walk(words: Iterator[str], heads: list[str], at: int, part: int) -> Iterator[np.ndarray]:
    """For each of a range's sorted words, the numbers of its beginnings, by length from 0."""
    later, border = (heads[at + 1], _border(heads, at + 1)) if at + 1 < len(heads) else ("", None)
    before, nodes, fresh = heads[at], _border(heads, at), part << _PART
    for word in words:
        have = common(before, word)
        new = len(word) - have
        nodes = np.concatenate([nodes[: have + 1], np.arange(fresh, fresh + new)])
        if border is not None and (n := common(word, later)) > have:
            nodes[have + 1 : n + 1] = border[have + 1 : n + 1]
        before, fresh = word, fresh + new
        yield nodes


def numbered(words: DataFrame) -> DataFrame:
    """Each different ``word`` with ``id`` (in the order of words), ``nodes`` (of its beginnings)
    and ``kinds`` (whether a code point is the first of a run), other columns as they are."""
    dealt = words.repartitionByRange("word").sortWithinPartitions("word")
    dealt = settled(dealt.withColumn("_part", F.spark_partition_id()))
    first = dict(dealt.groupBy("_part").agg(F.min("word")).collect())
    parts = sorted(first)
    heads, place = [first[p] for p in parts], {p: i for i, p in enumerate(parts)}
    out = T.StructType([*dealt.drop("_part").schema, *T.StructType.fromDDL("id long, nodes array<long>, kinds array<byte>")])
    arrow = to_arrow_schema(out)

    def lists(flat: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat), kind))

    def kinds_of(word: str) -> np.ndarray:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        kinds = np.full(len(points), _FIRST, np.int8)
        kinds[1:][points[1:] == points[:-1]] = _SKIP
        return kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one range: a checkpoint keeps its partitions and their order.
        queue: list[str] = []
        steps, n, part = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if steps is None:
                part = batch.column("_part")[0].as_py()
                steps = walk(iter(lambda: queue.pop(), None), heads, place[part], part)
            spelled = batch.column("word").to_pylist()
            queue[:] = spelled[::-1]
            nodes = [next(steps) for _ in spelled]
            ids = pa.array(np.arange(n, n + len(spelled)) + (part << _PART))
            n += len(spelled)
            own = [batch.column(f.name) for f in arrow if f.name in batch.schema.names]
            new = [ids, lists(nodes, pa.int64()), lists([kinds_of(w) for w in spelled], pa.int8())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own + new, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, out)


def pairs(words: DataFrame) -> DataFrame:
    """(before, behind, id, n, kind) of every place of every word of ``words`` (word, n, id, nodes, kinds)."""
    turned = numbered(words.select(F.reverse("word").alias("word"), F.col("id").alias("_id"))).select(F.col("_id").alias("id"), F.reverse("nodes").alias("ends"))
    length = F.size("kinds")
    before = F.concat(F.slice("nodes", F.lit(1), length), "nodes")
    behind = F.concat(F.slice("ends", F.lit(2), length), "ends")
    kinds = F.concat("kinds", F.array_repeat(F.lit(_SPLIT).cast("byte"), length + 1))
    at = F.arrays_zip(before.alias("before"), behind.alias("behind"), kinds.alias("kind"))
    return words.join(turned, "id").select("id", "n", F.inline(at).alias("before", "behind", "kind"))


def _met(a: Column, b: Column) -> Column:
    """Whether two members of a pair's group are near by it."""
    replaced = (a["kind"] != _SPLIT) & (b["kind"] != _SPLIT)
    left_out = ((a["kind"] == _FIRST) & (b["kind"] == _SPLIT)) | ((a["kind"] == _SPLIT) & (b["kind"] == _FIRST))
    return (a["id"] != b["id"]) & (replaced | left_out)


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have a near word; ``best`` is the one of largest n,
    and among those the first: its n and its id, negative."""
    # A group has no more members than the alphabet has code points, and one.
    groups = pairs(words).groupBy("before", "behind").agg(F.collect_list(F.struct("id", "n", "kind")).alias("have")).where(F.size("have") > 1)

    def answer(m: Column) -> Column:
        others = F.filter("have", lambda o: _met(m, o))
        return F.struct(m["id"].alias("id"), F.size(others).alias("n"), F.array_max(F.transform(others, lambda o: F.struct(o["n"].alias("n"), (-o["id"]).alias("id")))).alias("best"))

    found = groups.select(F.inline(F.transform("have", answer))).where("n > 0")
    return found.groupBy("id").agg(F.sum("n").alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root): ``links`` (id, to) followed to their end. Each step doubles what a link spans."""
    while True:
        on = links.select(F.col("id").alias("to"), F.col("to").alias("_on"))
        longer = settled(links.join(on, "to", "left").select("id", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("_more")))
        links = longer.select("id", "to")
        if not longer.where("_more").limit(1).count():
            return links.select("id", F.col("to").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every different word of ``words`` (word, n).

    ``form`` is the near word of largest n (ties: first in code-point order) if that n
    is at least ``ratio`` times the word's own, and ``root`` where forms lead from there.
    """
    each = words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    known = settled(numbered(each))
    told = settled(known.select("id", "word", "n").join(near(known), "id", "left").select("id", "word", "n", "n_near", F.when(F.col("best.n") >= F.col("n") * ratio, F.col("best")).alias("best")))
    linked = told.where("best is not null").select("id", (-F.col("best.id")).alias("to"))
    names = known.select("id", "word")
    ends = linked.join(roots(linked), "id")
    ends = ends.join(names.select(F.col("id").alias("to"), F.col("word").alias("form")), "to").join(names.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root")
    return told.join(ends.select("id", "form", "_root"), "id", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.n").alias("form_n")
    )
