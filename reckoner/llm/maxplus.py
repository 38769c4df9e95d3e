"""Piece encoding and decoding by a max-plus parallel scan.

The vocabulary is that of a SentencePiece model file; spaces are written as U+2581
with one in front, as that library does, and the ids are that library's. Best paths
are found over a lattice of character positions whose edges are pieces (a character
that no piece covers becomes its UTF-8 bytes):

* Unigram models: an edge weighs its piece's score (``unknown`` for an uncovered
  character), and of equal sums the one with the longer last piece is taken.
* Byte-pair models: an edge weighs nothing if its piece may stand behind the one
  before, that is if merging the two pieces' text gives the two pieces, and minus
  infinity if not. Merges in different pieces don't meet before one crosses a border
  between two, and which merge is first to cross depends on these two alone. So a path
  is finite exactly if it is what all merges give, and there is one such path.

Cut anywhere, a text's state at the cut is the piece that reaches up to it or over
it, so a chunk is a matrix over (state in, state out) with the best sum of each, and
matrices of neighbouring chunks combine by the associative max-plus product. Texts
of at least ``chunk_chars`` are split into chunks:

1. Each chunk's matrix is computed on its own, with the characters around its cuts.
2. Every ``FAN`` neighbours are combined into one matrix, and so on until one is left.
3. Downwards again, the states at the cuts inside each group follow from those at its
   ends, so no task holds more than ``FAN`` matrices of a text, however long it is.
4. Every chunk traces its path back independently.

A shorter text is one chunk. Where no piece holds U+2581 behind another character than
itself, paths meet in front of each run of U+2581. Such a run and the word behind it
are a unit, and each different unit is solved once. With other vocabularies a text is
one unit.

Decoding joins the pieces and gives back the text.

Defined results: null and empty texts have no pieces, and decode to the empty
text; equal texts have equal ids; extra columns stay as ``keep`` says; no documents
give no rows. ``chunk_chars`` must be larger than the longest piece.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm import words
from reckoner.llm.common import settled, with_results

SPACE = "▁"
CHUNK_CHARS = 1 << 15
#: Neighbouring matrices that one step combines.
FAN = 32
CACHE_WORDS = 100_000
CACHE_PAIRS = 300_000
#: Texts whose different words are looked up together, and units that one pass solves.
SLICE_BYTES = 2 << 20
PASS_UNITS = 1 << 14
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")
_BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_NONE = -np.inf


#: A state at a cut: characters of its piece before the cut and behind it.
State = tuple[int, int]
START: State = (0, 0)


class Pieces:
    """Pieces with scores, and best paths over them. ``merged``: of a byte-pair model."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], unknown: float, merged: bool = False):
        self.scores, self.byte_ids, self.unknown, self.merged = scores, byte_ids, unknown, merged
        self.longest = max(map(len, scores), default=1)
        #: Whether a piece goes on from a word into the spaces behind it.
        self.crosses = any(map(_BORDER.search, scores))
        #: Ids (32 bits each) of solved units; those not used since ``known`` was last full go.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Prefixes of pieces let the search stop early.
        self.heads = set() if merged else {p[:n] for p in scores for n in range(1, len(p) + 1)}
        self.inner = {p[n : n + 2] for p in scores for n in range(len(p) - 1)}
        self.number = {p: i for p, (i, _) in scores.items()}
        self.letters = {p for p in scores if len(p) == 1}
        #: Finds all pieces of a text, at each end the longest first: number, length, and by
        #: the number of a piece before it whether both fit.
        self.automaton = ahocorasick.Automaton()
        self.after: list[dict[int, bool]] = []
        self.n_pairs = 0
        #: Numbers behind those of the pieces: an uncovered character, and none.
        self.uncovered = max(self.number.values(), default=0) + 1
        #: A character that no piece has. The automaton looks through branches in the order they
        #: came, so with this one first a mark doesn't cost a look at all letters.
        used = set().union(*scores) if scores else set()
        self.mark = next(c for c in map(chr, range(1, 0x110000)) if c not in used)
        for p, i in [(self.mark, self.uncovered), *self.number.items()]:
            self.after.append({})
            self.automaton.add_word(p, (i, len(p), self.after[-1]))
        self.automaton.make_automaton()
        self.made: dict[str, bool] = {}
        #: Parts a text at characters that no piece has, and gives these too.
        self.foreign = re.compile(f"([^{re.escape(''.join(sorted(used)))}])" if used else r"([\s\S])")

    def _merge(self, text: str) -> list[str]:
        """What merges leave of a short text: the best-scored pair first, then the leftmost."""
        parts, scores = list(text), self.scores
        while True:
            best, at = _NONE, -1
            for k in range(len(parts) - 1):
                found = scores.get(parts[k] + parts[k + 1])
                if found is not None and found[1] > best:
                    best, at = found[1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _alone(self, piece: str) -> bool:
        """Whether merges make a piece of its own text."""
        got = self.made.get(piece)
        if got is None:
            got = self._merge(piece) == [piece]
            if piece in self.scores:
                self.made[piece] = got
        return got

    def fits(self, before: str, piece: str) -> bool:
        """Whether merges leave both pieces of their joined text ("" before a text's first)."""
        if not (self._alone(piece) and (not before or self._alone(before))):
            return False
        return not before or before[-1] + piece[0] not in self.inner or self._merge(before + piece) == [before, piece]

    def _learnt(self, table: dict[int, bool], former: int, before: str, piece: str) -> bool:
        """``fits`` of a pair that the piece's ``table`` doesn't have."""
        if self.n_pairs > CACHE_PAIRS:
            for t in self.after:
                t.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        fit = table[former] = self.fits(before, piece)
        return fit

    def _forward_merged(self, text: str, inside: int, start: int, before: str) -> tuple[list[float], list[int]]:
        """``_forward`` of a byte-pair model: at most one piece can end a path at a position."""
        n = len(text)
        best, last, ends = [_NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[start] = 0.0
        uncovered = self.uncovered
        ends[start] = self.number.get(before, uncovered) if before else uncovered + 1
        holes = [] if self.letters.issuperset(text) else [k for k in range(start, min(n, inside)) if text[k] not in self.letters]
        hole = 0
        for at, (own, size, table) in self.automaton.iter(text, start):
            while hole < len(holes) and holes[hole] < at:
                k = holes[hole]
                if ends[k] >= 0:
                    best[k + 1], last[k + 1], ends[k + 1] = 0.0, 1, uncovered
                hole += 1
            j = at + 1
            i = j - size
            if ends[j] >= 0 or i >= inside:
                continue
            former = ends[i]
            if former < 0:
                continue
            fit = table.get(former)
            if fit is None:
                fit = self._learnt(table, former, before if i == start else text[i - last[i] : i], text[i:j])
            if fit:
                best[j], last[j], ends[j] = 0.0, size, own
        for k in holes[hole:]:
            if ends[k] >= 0:
                best[k + 1], last[k + 1], ends[k + 1] = 0.0, 1, uncovered
        return best, last

    def _forward(self, text: str, inside: int, start: int = 0, before: str = "") -> tuple[list[float], list[int]]:
        """Best sums and last piece lengths at each position, from ``start`` on.

        Pieces begin before ``inside`` and may end up to the end of ``text``. ``before``:
        the piece that ends at ``start``.
        """
        if self.merged:
            return self._forward_merged(text, inside, start, before)
        n = len(text)
        best, last = [_NONE] * (n + 1), [0] * (n + 1)
        best[start] = 0.0
        scores, heads = self.scores, self.heads
        for i in range(start, inside):
            base = best[i]
            if base == _NONE:
                continue
            if text[i] not in scores and base + self.unknown > best[i + 1]:
                best[i + 1], last[i + 1] = base + self.unknown, 1
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = text[i:j]
                if piece not in heads:
                    break
                found = scores.get(piece)
                # Of equal sums the first found has the longer last piece.
                if found is not None and base + found[1] > best[j]:
                    best[j], last[j] = base + found[1], j - i
        return best, last

    def _ids(self, text: str, last: list[int], end: int, start: int) -> list[int]:
        out: list[int] = []
        while end > start:
            if not last[end]:
                raise ValueError("no path ends here")
            piece = text[end - last[end] : end]
            found = self.scores.get(piece)
            if found is not None:
                out.append(found[0])
            else:
                out += [self.byte_ids[b] for b in reversed(piece.encode())]
            end -= last[end]
        return out[::-1]

    def _solve(self, text: str) -> bytes:
        return np.array(self._ids(text, self._forward(text, len(text))[1], len(text), 0), np.int32).tobytes()

    def _solve_merged(self, units: list[str]) -> list[bytes]:
        """``_solve`` of units without uncovered characters, of a byte-pair model, in one pass.

        They stand in one text with a character between them that no piece has, so each
        begins anew; then the paths are read off from all ends at once.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        # Paths stand at the place of their last character; before a unit there is a mark.
        stop = np.cumsum(size + 1) - 1
        text = self.mark + self.mark.join(units)
        begin, n = self.uncovered + 1, len(text)
        ends, last = [-1] * n, [0] * n
        for k in (stop - size).tolist():
            ends[k] = begin
        for at, (own, length, table) in self.automaton.iter(text):
            if ends[at] >= 0:
                continue
            former = ends[at - length]
            if former < 0:
                continue
            fit = table.get(former)
            if fit is None:
                i = at - length + 1
                fit = self._learnt(table, former, "" if former == begin else text[i - last[i - 1] : i], text[i : at + 1])
            if fit:
                last[at], ends[at] = length, own
        back, piece = np.array(last), np.array(ends)
        here, steps = stop, []
        while len(here := here[piece[here] != begin]):
            if not back[here].all():
                raise ValueError("no path ends here")
            steps.append(here)
            here = here - back[here]
        path = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
        raw = piece[path].astype(np.int32).tobytes()
        cuts = [0, *(4 * np.searchsorted(path, stop, "right")).tolist()]
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def _solve_all(self, units: list[str]) -> dict[str, bytes]:
        """``_solve`` of different units.

        Merges don't reach over a character that no piece has, so in a byte-pair model what
        stands between such is solved like a unit.
        """
        easy, parted = [], {}
        if self.merged and not self.crosses:
            covers = self.letters.issuperset
            for u in units:
                if covers(u):
                    easy.append(u)
                elif all(map(covers, (parts := self.foreign.split(u))[::2])):
                    parted[u] = parts

        def passed(units: list[str]) -> dict[str, bytes]:
            passes = (units[at : at + PASS_UNITS] for at in range(0, len(units), PASS_UNITS))
            return {u: x for part in passes for u, x in zip(part, self._solve_merged(part), strict=True)}

        found = passed(easy)
        if parted:
            of = passed(list({x for parts in parted.values() for x in parts[::2] if x and x not in found})) | {"": b""}
            for x in {x for parts in parted.values() for x in parts[1::2]}:
                of[x] = np.array([self.byte_ids[b] for b in x.encode()], np.int32).tobytes()
            for u, parts in parted.items():
                found[u] = b"".join([of[x] if x in of else found[x] for x in parts])
        if len(found) < len(units):
            found |= {u: self._solve(u) for u in units if u not in found}
        return found

    def solved(self, units: list[str]) -> list[bytes]:
        """Ids of the best paths of units, 32 bits each."""
        known, older = self.known, self.older
        out = list(map(known.get, units))
        lacking = [k for k, x in enumerate(out) if x is None]
        if lacking:
            new = [u for k in lacking if (u := units[k]) not in older]
            found = self._solve_all(new) if new else {}
            if len(known) > CACHE_WORDS:
                known, self.older = {}, known
                self.known = known
            for k in lacking:
                u = units[k]
                x = found.get(u)
                out[k] = known[u] = older[u] if x is None else x
        return out

    def word(self, text: str) -> bytes:
        """Ids of a unit's best path, 32 bits each."""
        return self.solved([text])[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the count of each row."""
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        spaced = pc.replace_substring(texts, SPACE, " ")
        if self.crosses:
            code = spaced.dictionary_encode()
            each = self.solved([SPACE + t.replace(" ", SPACE) for t in code.dictionary.to_pylist()])
            unit, ends = code.indices.to_numpy(zero_copy_only=False), np.arange(1, len(texts) + 1)
        else:
            split = pc.split_pattern(spaced, " ")
            code = split.flatten().dictionary_encode()
            units = pc.binary_join_element_wise(SPACE, code.dictionary, "").to_pylist()
            each = self.solved(units)
            word = code.indices.to_numpy(zero_copy_only=False)
            last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)) - 1
            # Empty words are spaces more in front of the next word, or at the end of a text.
            closes = word != pc.index(code.dictionary, "").as_py()
            closes[last] = True
            at = np.flatnonzero(closes)
            more = np.diff(at, prepend=-1) - 1
            unit, wide = word[at].astype(np.int64), np.flatnonzero(more)
            different, place = np.unique(more[wide] * max(1, len(units)) + unit[wide], return_inverse=True)
            each += self.solved([SPACE * (k // len(units)) + units[k % len(units)] for k in different.tolist()])
            unit[wide] = len(units) + place
            ends = np.searchsorted(at, last) + 1
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        n = size[unit]
        # An empty text is one empty word, which stands for nothing.
        n[ends[empty] - 1] = 0
        ids = words.gathered(flat, (np.cumsum(size) - size)[unit], n)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)

    def _borders(self, text: str, inside: int) -> tuple[int, int]:
        """First and last place in a chunk where a path must break; (-1, -1) without."""
        first = None if self.crosses else _BORDER.search(text, 0, inside)
        if first is None:
            return -1, -1
        return first.start(), len(text[: text.rfind(SPACE, 0, inside)].rstrip(SPACE))

    def states(self, before: str, behind: str) -> list[State]:
        """The states at a cut between these characters, in the order of matrices.

        Before a text's first character there is one, behind its last also.
        """
        if not before or not behind:
            return [START]
        reach = min(self.longest - 1, len(behind))
        if not self.merged:
            return [(0, over) for over in range(reach + 1)]
        found = [(back, over) for back in range(1, min(self.longest, len(before)) + 1) for over in range(min(reach, self.longest - back) + 1) if before[-back:] + behind[:over] in self.scores]
        return found if before[-1] in self.scores else [(1, 0), *found]

    def _start(self, before: str, text: str, state: State) -> tuple[int, str]:
        back, over = state
        return over, (before[len(before) - back :] + text[:over] if self.merged else "")

    def matrix(self, before: str, text: str, behind: str) -> np.ndarray:
        """Best sum for each state in and out of a chunk between these characters."""
        inside, whole = len(text), text + behind
        out_states = self.states(text, behind)
        out = np.full((len(self.states(before, whole)), len(out_states)), _NONE)

        def ends(best: list[float], last: list[int], at: int) -> np.ndarray:
            if not behind or not self.merged:
                return np.array([best[at + over] for _, over in out_states])
            return np.array([best[at + over] if last[at + over] == back + over else _NONE for back, over in out_states])

        first, final = self._borders(whole, inside)
        middle = None
        for k, state in enumerate(self.states(before, whole)):
            start, former = self._start(before, whole, state)
            if first >= start:
                # Up to the first border, over whole units, and from the last border on.
                head = self._forward(whole[:first], first, start, former)[0][first]
                if middle is None:
                    # Every unit of a byte-pair model has a path, which weighs nothing.
                    between = 0.0 if self.merged else sum(self._forward(w, len(w))[0][-1] for w in _UNIT.findall(whole[first:final]))
                    middle = between + ends(*self._forward(whole[final:], inside - final), inside - final)
                out[k] = head + middle
            else:
                out[k] = ends(*self._forward(whole, inside, start, former), inside)
        return out

    def trace(self, before: str, text: str, behind: str, into: int, outof: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, on the best path between two states."""
        inside, whole = len(text), text + behind
        start, former = self._start(before, whole, self.states(before, whole)[into])
        end = inside + self.states(text, behind)[outof][1]
        first, final = self._borders(whole, inside)
        if first < start:
            return self._ids(whole, self._forward(whole, inside, start, former)[1], end, start)
        out = self._ids(whole[:first], self._forward(whole[:first], first, start, former)[1], first, start)
        out += np.frombuffer(b"".join(self.solved(_UNIT.findall(whole[first:final]))), np.int32).tolist()
        tail = whole[final:]
        return out + self._ids(tail, self._forward(tail, inside - final)[1], end - final, 0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def between(matrices: list[np.ndarray], into: int, outof: int) -> list[int]:
    """The state at each cut of the best path from state ``into`` to ``outof``.

    Products from the right give the best sum from each state at each cut to the end;
    the path is then read off cut by cut.
    """
    right = [matrices[-1][:, [outof]]]
    for m in reversed(matrices[:-1]):
        right.append(product(m, right[-1]))
    path = [into]
    for m, rest in zip(matrices[:-1], reversed(right[:-1]), strict=True):
        path.append(int(np.argmax(m[path[-1]] + rest[:, 0])))
    return [*path, outof]


def _model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Pieces of a SentencePiece model file; one for each worker process.

    Left out: control pieces, and bytes (only used for unknown characters).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, byte_ids = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[piece] = (i, float(model.get_score(i)))
    # 1: unigram, 2: byte pairs.
    return Pieces(scores, byte_ids, min(s for _, s in scores.values()) - 10, merged=_model_type(path) == 2)


class Decoder:
    """Bytes of ids; U+2581 is a space again."""

    def __init__(self, pieces: Pieces):
        named = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.scores.items()}
        named |= {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.size = np.zeros(max(named) + 1, np.int64)
        self.size[list(named)] = list(map(len, named.values()))
        self.begin = np.zeros_like(self.size)
        self.begin[list(named)] = np.cumsum(self.size[list(named)]) - self.size[list(named)]
        self.flat = np.frombuffer(b"".join(named.values()), np.uint8)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of rows of ids (row k has the next n[k]) and its offsets.

        Each row has the space in front that encoding put there.
        """
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return words.gathered(self.flat, self.begin[ids], size), ends[np.concatenate([[0], np.cumsum(n)])]

    def text(self, ids: np.ndarray) -> str:
        return self.decode(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(load(path))


def decode(ids: list[int], path: str) -> str:
    """The text of a sequence of ids."""
    return _decoder(path).text(np.asarray(ids, np.int64)) if len(ids) else ""


def _written(column: Column) -> Column:
    """Text with spaces as U+2581 and one in front; null and empty stay empty."""
    return F.when(F.length(column) > 0, F.concat(F.lit(SPACE), F.translate(column, " ", SPACE))).otherwise(F.lit(""))


def _short(docs: DataFrame, path: str, verify: bool, keep: list[str]) -> DataFrame:
    def work():
        pieces, decoder = load(path), _decoder(path)

        def compute(column: pa.Array) -> dict[str, object]:
            column = pc.fill_null(column, "")
            _, offsets = words.utf8(column)
            every, counts, same = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
            for a, b in words.slices(offsets, SLICE_BYTES):
                rows = column.slice(a, b - a)
                ids, n = pieces.ids(rows)
                every.append(ids)
                counts.append(n)
                if verify:
                    back, at = decoder.decode(ids, n)
                    want, place = words.utf8(pc.replace_substring(rows, SPACE, " "))
                    same += [np.array_equal(back[x + 1 : y], want[u:v]) for x, y, u, v in zip(at[:-1], at[1:], place[:-1], place[1:], strict=True)]
            begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            ids = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(np.concatenate(every)))
            return {"ids": ids, "same": same} if verify else {"ids": ids}

        return compute

    return with_results(docs, work, "ids array<int>" + ", same boolean" * verify, keep=keep)


def _chunks(docs: DataFrame, chunk: int, reach: int) -> DataFrame:
    """(_row, _at, _before, _text, _behind): a text's chunks with what stands around each."""
    n = F.length("_written")
    at = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("_at")
    first = F.col("_at") * chunk
    read = lambda begin, size: F.substr("_written", begin + 1, size)
    around = read(F.greatest(first - reach, F.lit(0)), F.least(first, F.lit(reach))).alias("_before"), read(first, F.lit(chunk)).alias("_text"), read(first + chunk, F.lit(reach)).alias("_behind")
    return docs.select("_row", "_written", at).select("_row", "_at", *around)


def _packed(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + m.astype(np.float64).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64, offset=8).reshape(np.frombuffer(raw, np.int32, 2))


def _states_at_cuts(matrices: DataFrame, n_chunks: int) -> DataFrame:
    """(_row, _at, _into, _outof) of every matrix (_row, _at, _matrix), by a scan over a tree."""

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        whole = functools.reduce(product, map(_unpacked, rows["_matrix"]))
        return pd.DataFrame({"_row": rows["_row"][:1], "_at": rows["_at"][:1] // FAN, "_matrix": [_packed(whole)]})

    def inner(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        path = between([_unpacked(m) for m in rows["_matrix"]], int(rows["_first"].iloc[0]), int(rows["_last"].iloc[0]))
        return pd.DataFrame({"_row": rows["_row"], "_at": rows["_at"], "_into": path[:-1], "_outof": path[1:]})

    group = (F.col("_at") / FAN).cast("int").alias("_group")
    levels = [matrices]
    while n_chunks > 1:
        levels.append(levels[-1].groupBy("_row", group).applyInPandas(combine, "_row binary, _at int, _matrix binary"))
        n_chunks = -(-n_chunks // FAN)
    found = levels[-1].select("_row", "_at", F.lit(0).alias("_into"), F.lit(0).alias("_outof"))
    for level in reversed(levels[:-1]):
        ends = found.select("_row", F.col("_at").alias("_group"), F.col("_into").alias("_first"), F.col("_outof").alias("_last"))
        held = level.select("*", group).join(ends, ["_row", "_group"])
        found = held.groupBy("_row", "_group").applyInPandas(inner, "_row binary, _at int, _into int, _outof int")
    return found


def _long(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(_row, ids) of texts in several chunks."""
    pieces = load(path)
    if chunk <= pieces.longest:
        raise ValueError(f"chunk_chars must be larger than {pieces.longest}")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # With a number, small chunks aren't put together in few tasks.
    chunks = _chunks(docs, chunk, pieces.longest).repartition(tasks, "_row", "_at")

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(path)
        for part in batches:
            made = [_packed(pieces.matrix(*x)) for x in zip(part["_before"], part["_text"], part["_behind"], strict=True)]
            yield pd.DataFrame({"_row": part["_row"], "_at": part["_at"], "_matrix": made})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(path)
        for part in batches:
            rows = zip(part["_before"], part["_text"], part["_behind"], part["_into"], part["_outof"], strict=True)
            yield pd.DataFrame({"_row": part["_row"], "_at": part["_at"], "_ids": [pieces.trace(*r) for r in rows]})

    longest = docs.agg(F.max(F.length("_written"))).first()[0] or 0
    matrices = settled(chunks.mapInPandas(transfer, "_row binary, _at int, _matrix binary"))
    at_cuts = _states_at_cuts(matrices, -(-longest // chunk))
    traced = chunks.join(at_cuts, ["_row", "_at"]).repartition(tasks, "_row", "_at").mapInPandas(trace, "_row binary, _at int, _ids array<int>")
    parts = traced.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_parts"))
    return parts.select("_row", F.flatten(F.col("_parts._ids")).alias("ids"))


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, verify: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` and, if ``verify``, ``same``: whether they decode to the text."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "same")])
    kept = [c for c in docs.columns if keep is None or c in keep]
    is_long = F.coalesce(F.length("text") >= chunk_chars, F.lit(False))
    short = _short(docs.where(~is_long), path, verify, kept)
    # A long text goes by its SHA-256, so equal texts share the work.
    long = docs.where(is_long).withColumn("_written", _written(F.col("text"))).withColumn("_row", F.unhex(F.sha2("_written", 256)))
    joined = long.join(_long(long.select("_row", "_written").dropDuplicates(["_row"]), path, chunk_chars), "_row")
    found = ["ids"]
    if verify:
        back = F.pandas_udf(lambda ids: ids.map(lambda x: decode(x, path)), T.StringType())
        found.append((back("ids") == F.translate("text", SPACE, " ")).alias("same"))
    return short.unionByName(joined.select(*kept, *found))
