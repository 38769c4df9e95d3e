"""Near duplicates by bottom-k sketches of word shingles.

A document's set is that of its distinct runs of ``size`` words. Of its hashes (one
hash function) the ``k`` smallest are its sketch. Documents with equal sets form a
class and are compared once, as one representative.

1. Candidates. A pair with Jaccard similarity of at least ``percent`` shares at least
   t sketch values (t: all that is certain for sets smaller than k; for larger ones a
   number that 0.75 misses with a probability below 1e-7). Ordered from rare to
   frequent, two sketches that share t values share one among the first m - t + 1 of
   m. Only these are put into inverted lists, so what many documents share (a license,
   a passage) makes no list for a document that has enough of its own.
2. Stars. Each inverted list is linked to ``PIVOTS`` pivots: members with the smallest
   hash under as many seeds. A list of n members gives a few n pairs, not n * n / 2.
3. Estimate. A pair stays if its sketches share t of the k smallest values of
   their union.
4. Verify. Exact Jaccard on the full sets decides.
5. Components of the links found so far. Members of lists that still hold several
   components are indexed once more, by their full sets: a set shares at least
   ``percent`` of its own size with any it is linked to, so of its shingles, rare ones
   first, the first quarter and one more is enough. A text with that many shingles of
   its own meets nobody. In these lists, members outside the component that most of
   the list belongs to are paired with members of other components, where sizes and the
   places of the shared value leave room for enough common shingles, and verified. So
   no link between different components is lost, and members of one component are not
   paired again.

Defined results: null and wordless texts have an empty set and link to nothing;
fewer than ``size`` words are one shingle; rows with equal doc_id are one document: it is
linked to whatever one of its texts is linked to, and all its rows have one component;
rows with a null doc_id take part, and their component is null if all its rows are so;
extra columns are not read. No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm import words
from reckoner.llm.common import settled, with_results

SHINGLE_WORDS = 5
PERCENT = 75
SKETCH = 48
#: Shared values that a pair of full sketches has at least, of 48 (mean 36 at 0.75).
SHARED = 19
BROADCAST_NODES = 1_000_000
PIVOTS = 3


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, w in words.batches_of_words(column):
        grams, begin = words.shingles(w.hashes(), w.first, size)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield np.unique(grams[a:b])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketched(docs: DataFrame, size: int = SHINGLE_WORDS, k: int = SKETCH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_shingles``, ``set_key`` (null if empty) and ``sketch``.

    set_key is a 128-bit digest of the sorted set.
    """

    def work():
        def compute(column: pa.Array) -> dict[str, object]:
            n, keys, sketches = [], [], []
            for grams in _sets(column, size):
                n.append(len(grams))
                keys.append(hashlib.blake2b(grams, digest_size=16).digest() if len(grams) else None)
                sketches.append(grams[:k])
            return {"n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "sketch": _lists(sketches)}

        return compute

    return with_results(docs, work, "n_shingles long, set_key binary, sketch array<long>", keep=keep)


def full_sets(docs: DataFrame, size: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``grams``, the whole sorted set."""

    def work():
        return lambda column: {"grams": _lists(list(_sets(column, size)))}

    return with_results(docs, work, "grams array<long>", keep=keep)


def _needed(m: Column, percent: int, k: int) -> Column:
    """Sketch values that a set of ``m`` shares with any set it may be linked to."""
    exact = F.ceil(m * percent / 100)
    return F.when(m <= k * percent // 100, exact).otherwise(F.lit(SHARED * k // SKETCH)).cast("int")


def _lists_of(values: DataFrame, needed: Column) -> DataFrame:
    """(value, place, node, n, rank) of lists that any pair sharing ``needed`` meets in.

    ``values`` has node, set (a node may have several), n, m (how many values the set has)
    and value. Rare values come first; those that no other node has match nothing. rank is the mean frequency of
    a node's values, less than 0: the lowest is at the centre of its group. Lists of one
    are left out.
    """
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(often, "value").groupBy("node", "set", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("have"))
    alone = F.col("m") - F.size("have")
    often = F.aggregate("have", F.lit(0).cast("long"), lambda total, x: total + x["df"])
    shared = shared.withColumns({"alone": alone, "rank": -(often + alone) / F.col("m")})
    use = F.col("m") - needed + 1 - F.col("alone")
    return shared.where(use > 0).select("node", "n", "alone", "rank", F.posexplode(F.slice("have", F.lit(1), F.greatest(use, F.lit(1)))).alias("at", "x")).select(
        F.col("x.value").alias("value"), (F.col("at") + F.col("alone")).alias("place"), "node", "n", "rank"
    )


def _merged(lists: DataFrame) -> DataFrame:
    """Lists with the same members as one list: one change of a text makes several
    shingles, whose lists are alike. A member has the best of its places."""
    alike = lists.groupBy("value").agg(F.bit_xor(F.xxhash64("node")).alias("same"), F.count("*").alias("of"))
    joined = lists.join(alike, "value").groupBy("same", "of", "node", "n").agg(F.min("place").alias("place"), F.min("rank").alias("rank"))
    return joined.select(F.xxhash64("same", "of").alias("value"), "place", "node", "n", "rank")


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be as similar as that."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch shows enough overlap."""
    a = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    enough = F.least(_needed(F.size(union), percent, k), F.ceil(F.size(union) * percent / 100))
    return pairs.join(b, "b").join(a, "a").where(shared >= enough).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are as similar as that."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    test = both * 100 >= (F.size("ga") + F.size("gb") - both) * percent
    return pairs.join(b, "b").join(a, "a").where(test).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: the smallest node that it reaches.

    Each step moves a node to its smallest neighbour's smallest neighbour and then
    contracts the graph to where its nodes went, so links within what has met are
    dropped and few are left for the next step; steps end when none is left. The smallest
    node of a component never moves.
    """
    steps, left = [], settled(links.select("a", "b").where("a <> b").distinct())
    while not steps or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("r")).select(F.col("a").alias("node"), F.least("a", "r").alias("to"))
        further = near.select(F.col("node").alias("to"), F.col("to").alias("on"))
        moved = settled(near.join(further, "to").select("node", F.col("on").alias("to")))
        at_a, at_b = moved.select(F.col("node").alias("a"), F.col("to").alias("x")), moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = settled(left.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.append(moved)
    roots = steps[0].select("node", F.col("to").alias("root"))
    for moved in steps[1:]:
        roots = roots.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return settled(roots) if len(steps) > 1 else roots


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of every list's members with the list's pivots."""
    # The first pivot is the member nearest the centre; others are random.
    key = [F.struct((F.col("rank") if s == 0 else F.lit(0)).alias("rank"), F.xxhash64("node", F.lit(s)).alias("h"), F.col("node").alias("pivot"), F.col("n").alias("m")) for s in range(PIVOTS)]
    stars = members.groupBy("value").agg(*[F.min(x).alias(f"p{s}") for s, x in enumerate(key)])
    stars = stars.select("value", F.inline(F.array(*[f"p{s}" for s in range(PIVOTS)]))).select("value", "pivot", "m").distinct()
    apart = (F.col("node") != F.col("pivot")) & _fits(F.col("n"), F.col("m"), percent)
    return members.join(stars, "value").where(apart).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _open(members: DataFrame) -> DataFrame:
    """Members of lists of several components, with the list's most frequent root."""
    most = members.groupBy("value", "root").count().groupBy("value").agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("roots"))
    return members.join(most.where("roots > 1").select("value", F.col("most.root").alias("most")), "value")


def _rest(some: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's members in different components.

    One of such a pair isn't in the component that most of the list's members have.
    The smaller set of a linked pair shares more of its size than the larger one, so
    for it only the beginning of its own order counts.
    """
    early = F.col("place") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent))
    some = some.withColumn("early", early)
    few = some.where("root <> most").select(
        "value", F.col("node").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("early").alias("soon"), F.col("place").alias("stands")
    )
    meet = F.when(F.col("n") < F.col("m"), F.col("early")).when(F.col("n") > F.col("m"), F.col("soon")).otherwise(F.col("early") & F.col("soon"))
    # At the first value that a pair shares, no more than what stands behind it can be common.
    common = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("stands")) >= common
    apart = (F.col("root") != F.col("other")) & meet & room & _fits(F.col("n"), F.col("m"), percent)
    return some.join(few, "value").where(apart).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def linked(classes: DataFrame, texts: DataFrame, own: DataFrame, size: int, percent: int, k: int) -> DataFrame:
    """(node, root) of the classes that have a link; ``texts`` has node and text.

    ``own`` has links known beforehand (a, b). A node of several classes is one document
    with several texts.
    """
    values = classes.select("node", "set", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    index = settled(_lists_of(values, _needed(F.col("m"), percent, k)))
    nodes = settled(index.select("node").distinct())
    # Texts are shuffled only where the ids are too many to be sent to every task.
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    sets = settled(full_sets(texts.join(wanted, "node"), size, keep=["node"]).where(F.size("grams") > 0))

    def verified(pairs: DataFrame) -> DataFrame:
        # A pivot is in many pairs. Without an aggregate behind the joins, Spark can split it.
        return settled(_verified(pairs, sets, percent))

    def rooted(lists: DataFrame) -> DataFrame:
        return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = verified(_estimated(_stars(index, percent), classes, percent, k)).union(settled(own))
    roots = components(links)
    still = _open(rooted(index)).select("node").distinct()
    n = F.size("grams").cast("long")
    grams = sets.join(still, "node").select("node", F.xxhash64("grams").alias("set"), n.alias("n"), n.alias("m"), F.explode("grams").alias("value")).distinct()
    exact = _lists_of(grams, F.ceil(F.col("m") * percent / 100).cast("int"))
    # These lists are of full sets; sketches have nothing to add.
    lists = settled(rooted(_merged(settled(exact))))
    more = verified(_rest(settled(_open(lists)), percent))
    return components(links.union(more)) if more.limit(1).count() else roots


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    component_id is the smallest doc_id reachable by links; kept marks its document.
    """
    each = settled(sketched(docs, size, k, keep=["doc_id"]))
    # A class goes by its smallest doc_id. Two classes of one name are texts of one document.
    named = each.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = settled(classes.withColumn("set", F.xxhash64("set_key")))
    # Documents of several rows link the classes of their texts.
    repeated = settled(each.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    of_doc = named.join(repeated, "doc_id").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
    own = of_doc.join(of_doc.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = linked(classes.select("node", "set", "n", "sketch"), docs.select(F.col("doc_id").alias("node"), "text"), own, size, percent, k)
    of_key = classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    found = each.select("doc_id", "n_shingles", "set_key").join(of_key, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    if repeated.limit(1).count():
        # A row without words goes with the other rows of its document.
        least = found.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
        found = found.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, **options: int) -> DataFrame:
    """One row of ``docs`` of each component, all its columns unchanged.

    That is the row of the document that is kept; of several such rows, the smallest by
    its columns (those that have an order). Rows with a null doc_id have no document that
    could be named, and stay, copies too.
    """
    found = settled(near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")))
    gone, several = found.where("not kept").select("doc_id"), found.where("kept and n > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    if not several.limit(1).count():
        return kept.select(docs.columns)
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("row")
    single = kept.join(several, "doc_id").groupBy(F.col("doc_id").alias("_id")).agg(row).select("row.*")
    return kept.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(single)
