"""Benchmark decontamination by greedy string tiling.

A document is compared with every benchmark item that shares a seed with it: a run
of ``seed_words`` words with the same Karp-Rabin hash. For such a pair the longest
common run of unmarked words is marked, again and again, until none of
``seed_words`` is left. Tiles may lie in any order, so shuffled passages count.
The share of the item's words under tiles is its coverage.

A pair is tiled by lengths, the longest first, with running hashes of the words. Whether
any run of a length is left in common is told by the hashes of all unmarked runs of that
length, so the longest is found by halving. Then, from the beginning of the document on,
each unmarked run of that length is marked with the first unmarked one of the item that has
its hash. So no list of all matches is made, and a refrain that both texts repeat takes
time for its places in either, not for their pairs. A tile counts only if its words are
equal, byte by byte.

Defined results: a null or wordless text is clean with coverage 0 and no item; a
null or wordless item matches nothing; an item shorter than a seed matches only as
a whole; of items with equal coverage the smallest id is named; repeated
documents get equal rows; every column of the documents is kept, save those named
like a result, whatever their case. An empty benchmark leaves all documents clean; no
documents give no rows.

Scale: one pass over the documents, without a shuffle. The benchmark is dealt into
blocks of ``block_bytes`` at most, each broadcast and matched in a pass of its own.
Where there are several, each pass but the last is written to the checkpoint folder
and its block given up, so neither driver nor executors ever hold more than one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm import words
from reckoner.llm.common import settled, with_results, without

SEED_WORDS = 4
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20
#: Pairs of a document's seeds and items that are looked at together.
PART = 1 << 20
_SIEVE_BITS = 22


def _running(hashed: np.ndarray) -> np.ndarray:
    """Running Karp-Rabin sums: those of a run of words come from their difference."""
    total = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * words._power("up", len(hashed)), out=total[1:])
    return total


class Block:
    """Seeds of some benchmark items, to be broadcast."""

    def __init__(self, items: pa.Table, seed_words: int):
        order = np.argsort(np.asarray(items.column("item_id").to_numpy(zero_copy_only=False)), kind="stable")
        self.ids = [items.column("item_id")[int(k)].as_py() for k in order]
        texts = items.column("text").combine_chunks().take(pa.array(order))
        data, offsets = words.utf8(texts.cast(pa.string()))
        w = words.Words(data, offsets)
        self.words, hashed, self.size = w, w.hashes(), w.counts()
        self.running, self.down = _running(hashed), words._power("down", len(hashed) + 1).copy()
        self.flat, self.begin = words.shingles(hashed, w.first, seed_words)
        # An item shorter than a seed is one seed of its own length. Each different seed of an item is listed once.
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.begin))
        by = np.lexsort((owner, self.flat))
        grams, owner = self.flat[by], owner[by]
        new = np.ones(len(by), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.grams, self.owner = grams[new], owner[new]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.grams >> np.uint64(64 - _SIEVE_BITS)] = True
        self.short = sorted({int(n) for n in self.size if 0 < n < seed_words})

    def seeds(self, item: int) -> np.ndarray:
        return self.flat[self.begin[item] : self.begin[item + 1]]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places in ``grams`` of seeds that some item has."""
        maybe = np.flatnonzero(self.sieve[grams >> np.uint64(64 - _SIEVE_BITS)])
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), max(0, len(self.grams) - 1))
        return maybe[self.grams[at] == grams[maybe]] if len(self.grams) else maybe[:0]

    def pairs(self, rows: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """row * number of items + item, in order, of rows and items that share one of ``grams``."""
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        rows, grams = rows[new], grams[new]
        left, right = (np.searchsorted(self.grams, grams, side) for side in ("left", "right"))
        ends = np.cumsum(right - left)
        found = np.zeros(0, np.int64)
        # In parts, however many items have a seed.
        for a in range(0, int(ends[-1]) if len(ends) else 0, PART):
            pair = np.arange(a, min(a + PART, int(ends[-1])))
            k = np.searchsorted(ends, pair, "right")
            item = self.owner[left[k] + pair - (ends[k] - (right - left)[k])]
            found = np.union1d(found, rows[k] * len(self.ids) + item)
        return found


class Side:
    """One text of a pair: where shared seeds stand in it, its words' running hashes, and its marks."""

    def __init__(self, at: np.ndarray, n_words: int, running: np.ndarray, down: np.ndarray):
        self.at, self.running, self.down = at, running, down
        self.marked = np.zeros(n_words, bool)

    def longest(self, seed: int) -> int:
        """The words of its longest row of shared seeds."""
        breaks = np.flatnonzero(np.diff(self.at) != 1)
        return int(np.diff(np.concatenate([[-1], breaks, [len(self.at) - 1]])).max()) + seed - 1

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the unmarked runs of ``n`` words that begin with a shared seed."""
        at = self.at[self.at + n <= len(self.marked)]
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = at[before[at + n] == before[at]]
        return at, (self.running[at + n] - self.running[at]) * self.down[at]

    def mark(self, at: int, n: int) -> None:
        self.marked[at : at + n] = True

    def cut(self, at: int, n: int) -> bool:
        """Whether a run that was free before runs of ``n`` words were marked is so no more."""
        return bool(self.marked[at] or self.marked[at + n - 1])


def tiles(a: Side, b: Side, seed: int, equal: Callable[[int, int, int], bool] = lambda i, j, n: True) -> list[tuple[int, int, int]]:
    """Greedy tiles (place, item place, length) of a pair, of ``seed`` words at least.

    The longest common run of unmarked words is marked first (ties: the earliest in ``a``,
    then in ``b``). ``equal`` tells whether the words of a tile are the same.
    """
    found = []
    high = min(a.longest(seed), b.longest(seed))
    while high >= seed:
        low, runs = seed - 1, None
        while low < high:
            mid = (low + high + 1) // 2
            (i, hi), (j, hj) = a.runs(mid), b.runs(mid)
            if np.isin(hi, hj).any():
                low, runs = mid, (i, hi, j, hj)
            else:
                high = mid - 1
        if runs is None:
            break
        i, hi, j, hj = runs
        places: dict[int, list[int]] = defaultdict(list)
        for h, y in zip(hj.tolist(), j.tolist(), strict=True):
            places[h].append(y)
        first = dict.fromkeys(places, 0)
        some = np.isin(hi, hj)
        for x, h in zip(i[some].tolist(), hi[some].tolist(), strict=True):
            if a.cut(x, low):
                continue
            have, k = places[h], first[h]
            while k < len(have) and b.cut(have[k], low):
                k += 1
            first[h] = k
            # Equal hashes of different words: another place may have the words.
            y = next((y for y in have[k:] if not b.cut(y, low) and equal(x, y, low)), None)
            if y is not None:
                a.mark(x, low)
                b.mark(y, low)
                found.append((x, y, low))
        high = low - 1
    return found


def _equal(w: words.Words, a: int, v: words.Words, b: int, n: int) -> bool:
    size = w.ends[a : a + n] - w.starts[a : a + n]
    other = v.ends[b : b + n] - v.starts[b : b + n]
    return np.array_equal(size, other) and np.array_equal(words.gathered(w.data, w.starts[a : a + n], size), words.gathered(v.data, v.starts[b : b + n], other))


def _judge(block: Block, seed_words: int):
    def compute(column: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
        n = len(column)
        best, item, count = np.zeros(n), [None] * n, np.zeros(n, np.int32)
        for a, _, w in words.batches_of_words(column):
            hashed, n_words = w.hashes(), w.counts()
            running, down = _running(hashed), words._power("down", len(hashed) + 1)
            for size in [seed_words, *block.short]:
                # Rows with fewer words than ``size`` have one shingle, of another length.
                grams, begin = words.shingles(hashed, w.first, size)
                row_of = np.repeat(np.arange(len(n_words)), np.diff(begin))
                p = block.hits(grams)
                p = p[n_words[row_of[p]] >= size]
                at = np.searchsorted(row_of[p], np.arange(len(n_words) + 1))
                for code in block.pairs(row_of[p], grams[p]).tolist():
                    r, which = divmod(code, len(block.ids))
                    if min(int(block.size[which]), seed_words) != size:
                        continue
                    mine, theirs = p[at[r] : at[r + 1]], block.seeds(which)
                    mine = mine[np.isin(grams[mine], theirs)]
                    here, there = int(w.first[r]), int(block.words.first[which])
                    x = Side(mine - begin[r], int(n_words[r]), running[here:], down[here:])
                    y = Side(np.flatnonzero(np.isin(theirs, grams[mine])), int(block.size[which]), block.running[there:], block.down[there:])
                    marked = tiles(x, y, size, lambda i, j, n: _equal(w, here + i, block.words, there + j, n))  # noqa: B023
                    cover = sum(t[2] for t in marked) / int(block.size[which])
                    if cover > best[a + r] or cover == best[a + r] > 0 and block.ids[which] < item[a + r]:
                        best[a + r], item[a + r], count[a + r] = cover, block.ids[which], len(marked)
        return best, item, count

    return compute


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    coverage: float = COVERAGE,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``contaminated``, ``item_id``, ``coverage`` and ``n_tiles``.

    item_id, coverage and n_tiles are those of the item with the largest coverage;
    a document is contaminated if that is at least ``coverage``.
    """
    spark = docs.sparkSession
    # One aggregate row; the text stays on the executors.
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    docs = without(docs, "item_id", "coverage", "n_tiles", "contaminated")
    kept = [c for c in docs.columns if keep is None or c in keep]
    out = docs
    for b in range(n_blocks):
        items = benchmark.where((part == b) & F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").toArrow()
        block = spark.sparkContext.broadcast(Block(items, seed_words))

        def work(block=block):
            compute = _judge(block.value, seed_words)

            def named(column: pa.Array) -> dict[str, object]:
                cover, item, count = compute(column)
                return {f"_item{b}": pa.array(item), f"_cover{b}": cover, f"_tiles{b}": count}

            return named

        last = b == n_blocks - 1
        carried = [f"_{x}{c}" for c in range(b) for x in ("item", "cover", "tiles")]
        out = with_results(out, work, f"_item{b} {id_type}, _cover{b} double, _tiles{b} int", keep=[*kept, *carried] if last else [*dict.fromkeys([*kept, "text"]), *carried])
        if not last:
            out = settled(out)
            block.destroy()
    best = F.struct(F.col("_cover0").alias("c"), F.col("_item0").alias("i"), F.col("_tiles0").alias("t"))
    for b in range(1, n_blocks):
        other = F.struct(F.col(f"_cover{b}").alias("c"), F.col(f"_item{b}").alias("i"), F.col(f"_tiles{b}").alias("t"))
        better = (other["c"] > best["c"]) | ((other["c"] == best["c"]) & (other["i"] < best["i"]))
        best = F.when(better, other).otherwise(best)
    return out.select(*kept, best.alias("_best")).select(
        *kept,
        (F.col("_best.c") >= coverage).alias("contaminated"),
        F.col("_best.i").alias("item_id"),
        F.col("_best.c").alias("coverage"),
        F.col("_best.t").alias("n_tiles"),
    )
