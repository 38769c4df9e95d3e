"""Token counts of greedy longest-match word pieces, by a linear automaton.

The vocabulary is a trie whose nodes carry, beside their edges, a failure link and
the number of pieces that following it pops (Aho-Corasick links as changed for
longest-match-first tokenization). A word is read once, byte by byte: where no edge
goes on, the failure link is taken and its popped pieces are counted. The pieces
themselves are never built. A word that the vocabulary can't cover counts as one
unknown piece.

Words are runs outside space and 0x09-0x0D, A-Z lower-cased, closed by the
vocabulary's end-of-word mark.

Defined results: null and empty texts have no words and no pieces; repeated rows
give equal rows; extra columns are kept or dropped as ``keep`` says, and give way to
results of their name; no documents give no rows.

Scale: no shuffle; the automaton is read from the vocabulary file by each worker;
of a batch, each different word is walked once.
"""

from __future__ import annotations

import functools
import json
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reckoner.llm import words
from reckoner.llm.common import with_results

CACHE_WORDS = 500_000
_FAIL = -1


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and that byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary(path: str, end: str = "</w>") -> list[tuple[bytes, bool]]:
    """(bytes, whether it ends a word) of every piece of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", ())}
    letters = byte_letters()
    pieces = []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            last = piece.endswith(end)
            body = piece.removesuffix(end) if last else piece
            pieces.append((bytes(letters[c] for c in body), last))
    return pieces


class Automaton:
    """Counts the pieces of a word in one pass over its bytes.

    The last byte of a word is read as a symbol of its own, byte + 256, so that only
    pieces with the end-of-word mark match there.
    """

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        self.edge: dict[int, int] = {}
        is_piece = [False]
        first, symbol = [0], [0]
        for body, last in pieces:
            node = 0
            for s in (*body[:-1], body[-1] + 256) if last else body:
                to = self.edge.get(node << 9 | s)
                if to is None:
                    to = self.edge[node << 9 | s] = len(is_piece)
                    is_piece.append(False)
                    first.append(node)
                    symbol.append(s)
                node = to
            if node:
                is_piece[node] = True
        self._link(is_piece, first, symbol)

    def _link(self, is_piece: list[bool], parent: list[int], symbol: list[int]) -> None:
        """Failure links and popped-piece counts, from the root outwards."""
        n = len(is_piece)
        self.fail, self.popped = [_FAIL] * n, [0] * n
        below: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            below[parent[v]].append(v)
        queue = deque(below[0])
        while queue:
            v = queue.popleft()
            queue.extend(below[v])
            if is_piece[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, popped = self.fail[parent[v]], self.popped[parent[v]]
            while z != _FAIL and (to := self.edge.get(z << 9 | symbol[v])) is None:
                popped += self.popped[z]
                z = self.fail[z]
            if z != _FAIL:
                self.fail[v], self.popped[v] = to, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if the vocabulary can't cover it."""
        edge, node, n = self.edge, 0, 0
        for s in (*word[:-1], word[-1] + 256):
            while (to := edge.get(node << 9 | s)) is None:
                n += self.popped[node]
                node = self.fail[node]
                if node == _FAIL:
                    return -1
            node = to
        while node:
            n += self.popped[node]
            node = self.fail[node]
            if node == _FAIL:
                return -1
        return n


@functools.lru_cache(maxsize=2)
def _automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    return Automaton(vocabulary(path)), {}


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` (an uncovered word is one) and ``n_unknown``."""

    def work():
        automaton, known = _automaton(path)

        def compute(column: pa.Array) -> dict[str, np.ndarray]:
            n_words, n_tokens, n_unknown = (np.zeros(len(column), np.int64) for _ in range(3))
            _, offsets = words.utf8(column)
            for a, b in words.slices(offsets):
                split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(a, b - a), "")))
                code = split.flatten().dictionary_encode()
                distinct = code.dictionary.to_pylist()
                if len(known) > CACHE_WORDS:
                    known.clear()
                counts = np.zeros(len(distinct), np.int64)
                for k, word in enumerate(distinct):
                    if word:
                        n = known.get(word)
                        if n is None:
                            n = known[word] = automaton.count(word.encode())
                        counts[k] = n
                index = code.indices.to_numpy(zero_copy_only=False)
                each = counts[index]
                ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
                for out, x in ((n_words, each != 0), (n_tokens, np.abs(each)), (n_unknown, each < 0)):
                    total = np.concatenate([[0], np.cumsum(x)])
                    out[a:b] = np.diff(total[ends], prepend=0)
            return {"n_words": n_words, "n_tokens": n_tokens, "n_unknown": n_unknown}

        return compute

    return with_results(docs, work, "n_words long, n_tokens long, n_unknown long", keep=keep)
