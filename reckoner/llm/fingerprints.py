"""I-Match fingerprints of documents, with DataFrame functions alone.

Terms are maximal runs of letters and digits, lower-cased. The lexicon is the band of
terms whose document frequency lies between ``LEAST_SHARE`` and ``MOST_SHARE`` of
all documents (at least ``LEAST_DOCS``), that is, of a middle inverse document
frequency. Each term of the lexicon falls, by seeded hashes, into at most one of
``SUBSETS`` random subsets in each of ``FAMILIES``: families whose subsets are small
serve long documents, those whose subsets are large serve short ones. A document's
distinct terms in a subset are sorted and hashed; the fingerprint is the list of
(subset, hash). A change touches only the subsets of the terms that changed, so the
share of equal hashes among the subsets that either document has terms in is the
likeness of two fingerprints.

A text with few terms of the lexicon would have a fingerprint of few hashes. So one with
less than twice ``LEAST_TERMS`` of them also has hashes of all its terms, in or out of the
band, in subsets of their own; one with less than ``LEAST_TERMS`` has only these. The
text alone decides, so equal texts have equal fingerprints, and two fingerprints are
compared on the kinds of hashes that both have: around either limit both texts still have
one kind in common.

Defined results: null and empty texts have an empty fingerprint; two empty
fingerprints have likeness 1, an empty one and another 0. Rows are ordered by doc_id
and text, also those of one doc_id; a row with a null doc_id has no place in the order,
and its next document counts as empty; extra columns are not read; no documents give no
rows.

Scale: one shuffle of the texts (to blocks of neighbouring ids, where the next
document and all of a document's terms are at hand) and one of term counts, summed
before they move. Blocks are cut between quantiles of the ids, so dense, sparse and
hash-like ones fill them alike; rows of one doc_id share a block. A term of the lexicon
is in at least ``LEAST_SHARE`` of all documents, so with d distinct terms in a mean
document the lexicon, which is broadcast, has at most d / LEAST_SHARE terms, however many
documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckoner.llm.common import settled

LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0005, 0.1, 2
LEAST_TERMS = 8
SUBSETS = 64
#: One in so many terms is in a given subset.
FAMILIES = (64, 512, 4096)
#: The first subset of all terms, in or out of the lexicon.
ALL_TERMS = len(FAMILIES) * SUBSETS
BLOCK = 256
#: Parts of the ids with equally many documents, each cut evenly into blocks.
QUANTILES = 256
HASHES = 1 << 32
_NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes."""
    split = F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != "")
    return F.array_distinct(F.transform(split, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame) -> DataFrame:
    """Terms of the band; the thresholds come from the number of all documents."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= max(LEAST_DOCS, LEAST_SHARE * n)) & (F.col("df") <= max(LEAST_DOCS, MOST_SHARE * n))).select("term")


def _next_blocks(ids: DataFrame) -> DataFrame:
    """(block, ahead): each block's smallest id and the block before it, in a circle.

    The blocks are ordered in groups of ``BLOCK``, the groups in groups again, so no
    task orders more than their number over BLOCK * BLOCK.
    """
    heads = ids.groupBy("block").agg(F.min("doc_id").alias("head"))
    level = heads.select("block", "head", F.floor(F.col("block") / BLOCK).alias("g")).withColumn("h", F.floor(F.col("g") / BLOCK))
    in_group = Window.partitionBy("g").orderBy("block")
    level = settled(level.withColumn("ahead", F.lag("block").over(in_group)).withColumn("is_last", F.lead("block").over(in_group).isNull()))
    # The last block of each group, and through them the block before each group's first.
    lasts = level.where("is_last").select("g", "h", F.col("block").alias("end"))
    in_super = Window.partitionBy("h").orderBy("g")
    lasts = settled(lasts.withColumn("before", F.lag("end").over(in_super)).withColumn("is_top", F.lead("g").over(in_super).isNull()))
    tops = lasts.where("is_top").select("h", F.col("end").alias("top_end"))
    tops = tops.withColumn("before_top", F.lag("top_end").over(Window.orderBy("h")))
    final = tops.agg(F.max("top_end").alias("final"))
    lasts = lasts.join(tops.select("h", "before_top"), "h").crossJoin(F.broadcast(final)).select("g", F.coalesce("before", "before_top", "final").alias("before_group"))
    return level.join(lasts, "g").select("block", "head", F.coalesce("ahead", "before_group").alias("ahead"))


def _fingerprint(found: Column) -> Column:
    """The (subset, hash) entries of sorted (subset, term) codes, as longs.

    One pass over the sorted codes: the hash of the subset in progress is carried on
    and put out when the subset changes.
    """
    start = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("out"))
    put = lambda acc: F.when(acc["s"] < 0, acc["out"]).otherwise(F.array_append(acc["out"], acc["s"] * HASHES + F.pmod(acc["h"], F.lit(HASHES))))

    def step(acc: Column, code: Column) -> Column:
        same = acc["s"] == code["s"]
        return F.struct(
            code["s"].alias("s"), F.when(same, F.xxhash64(acc["h"], code["t"])).otherwise(F.xxhash64(code["t"])).alias("h"), F.when(same, acc["out"]).otherwise(put(acc)).alias("out")
        )

    return F.aggregate(F.array_sort(found), start, step, put)


def _codes(terms_: Column, first: Column) -> Column:
    """(subset, term) of every subset that a term falls into, subsets counted from ``first``."""

    def family(k: int, rate: int) -> Column:
        subset = lambda t: F.pmod(F.xxhash64(t, F.lit(k + 1)), F.lit(rate))
        chosen = F.filter(terms_, lambda t: subset(t) < SUBSETS)
        return F.transform(chosen, lambda t: F.struct((subset(t) + first + k * SUBSETS).alias("s"), t.alias("t")))

    return F.concat(*[family(k, rate) for k, rate in enumerate(FAMILIES)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of either fingerprint, of the kinds that both have.

    Entries are in the order of their subsets, those of the lexicon first.
    """
    band = lambda x: F.coalesce(F.get(x, F.lit(0)) < ALL_TERMS * HASHES, F.lit(False))
    every = lambda x: F.coalesce(F.get(x, F.size(x) - 1) >= ALL_TERMS * HASHES, F.lit(False))
    of_both = lambda x, y: F.when(band(x) & ~band(y), F.filter(x, lambda e: e >= ALL_TERMS * HASHES)).when(every(x) & ~every(y), F.filter(x, lambda e: e < ALL_TERMS * HASHES)).otherwise(x)
    u, v = of_both(a, b), of_both(b, a)
    subset = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(subset(u), subset(v)))
    none = F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(0.0)
    return F.when(either == 0, none).otherwise(F.size(F.array_intersect(u, v)) / either)


def _hex(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 11, "0"))), "")


def _block(docs: DataFrame) -> Column:
    """The block of a doc_id: growing with it, of about ``BLOCK`` documents each."""
    shares = [k / QUANTILES for k in range(QUANTILES)]
    found = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", shares, 100 * QUANTILES).alias("at"), F.max("doc_id").alias("last")).first()
    if not found["n"]:
        return F.lit(0).cast("long")
    begins = sorted(set(found["at"]))
    ends = [*begins[1:], found["last"] + 1]
    per = max(1, round(found["n"] / len(begins) / BLOCK))
    # Ids below the first quantile that the estimate gives belong to its part.
    part = F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(b) for b in begins]), lambda b: b <= F.col("doc_id"))) - 1)
    low, high = (F.get(F.array(*[F.lit(float(x)) for x in xs]), part) for xs in (begins, ends))
    inside = F.floor((F.col("doc_id").cast("double") - low) / (high - low) * per)
    return (part * per + F.least(F.greatest(inside, F.lit(0)), F.lit(per - 1))).cast("long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    The edited text has its last quarter replaced by the beginning of the next document's.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", _block(rows))
    # Rows without an id are spread over blocks below all others.
    rows = rows.withColumn("block", F.when(F.col("doc_id").isNotNull(), F.col("block")).otherwise(F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(2**20))))
    order = _next_blocks(rows.where("doc_id is not null").select("block", "doc_id"))
    lex = settled(lexicon(rows))

    # The head of the following block is copied into each block, as a guest.
    heads = rows.where("doc_id is not null").groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    guests = order.select("block", "ahead").join(heads, "block").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.col("ahead").alias("block"), F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", "block", F.lit(False).alias("guest")).unionByName(guests).repartition("block")
    by_place = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    placed = dealt.withColumn("next", F.when(F.col("doc_id").isNotNull(), F.lead("text").over(by_place))).withColumn("place", F.row_number().over(by_place))

    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    texts = placed.select("block", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(edited).alias("changed"))

    # All terms of a document are looked up within its block, those that both texts have
    # once. Its other figures ride on a term of their own, 0, that the lexicon always has.
    about = F.struct("guest", "doc_id", "n_chars", "edited_sha256", "own", "changed")
    none = F.when(F.lit(False), about)

    def items_of(terms_: Column, which: int) -> Column:
        return F.transform(terms_, lambda t: F.struct(F.lit(which).alias("which"), t.alias("term"), none.alias("about")))

    rider = F.array(F.struct(F.lit(0).alias("which"), F.lit(0).cast("long").alias("term"), about.alias("about")))
    only, common, new = F.array_except("own", "changed"), F.array_intersect("own", "changed"), F.array_except("changed", "own")
    items = F.concat(rider, items_of(only, 1), items_of(common, 3), items_of(new, 2))
    known = F.broadcast(lex.union(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("term"))))
    found = texts.select("block", "place", F.inline(items)).join(known, "term").groupBy("block", "place").agg(
        F.collect_list(F.when(F.col("which").isin(1, 3), F.col("term"))).alias("own"),
        F.collect_list(F.when(F.col("which").isin(2, 3), F.col("term"))).alias("changed"),
        F.first("about", ignorenulls=True).alias("about"),
    )
    nothing = F.array().cast("array<struct<s:bigint,t:bigint>>")

    def marks(c: str) -> Column:
        n = F.size(c)
        band = F.when(n >= LEAST_TERMS, _codes(F.col(c), F.lit(0))).otherwise(nothing)
        return _fingerprint(F.concat(band, F.when(n < 2 * LEAST_TERMS, _codes(F.col(f"about.{c}"), F.lit(ALL_TERMS))).otherwise(nothing)))

    marked = found.select("block", "place", "about", marks("own").alias("a"), marks("changed").alias("b"))
    following = F.lead("a").over(Window.partitionBy("block").orderBy("place"))
    out = marked.withColumn("c", F.when(F.col("about.doc_id").isNotNull(), following)).where("not about.guest")
    return out.select(
        "about.doc_id",
        "about.n_chars",
        "about.edited_sha256",
        _hex(F.col("a")).alias("fingerprint"),
        _hex(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.coalesce("c", F.array().cast("array<bigint>"))).alias("near_next"),
    )
