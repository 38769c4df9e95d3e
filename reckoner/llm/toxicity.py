"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A
window of a document that the toxic one compresses to fewer bytes speaks for
toxicity. To give a short word the weight of a long match, a letter is written as
``CODE_BYTES`` pseudo-random bytes that depend on its word up to there: zstandard
then matches words and word beginnings, and only those.

The toxic dictionary holds the ordinary one as well, in the same place, so that a
difference can only come from what toxic text has beyond ordinary text. It is
trained on toxic documents without the words that ordinary ones have nearly as often:
trained on their whole text, it mostly holds ordinary text (README has the figures).
Figures over the windows of a document (largest and mean differences, share of
conspicuous windows) go to a logistic function. It is calibrated on rows that the
dictionaries haven't seen: one in ``CALIBRATION_FOLDS`` of the labelled rows is kept for that.

Learning reads a bounded sample: at most ``sample_rows`` labelled documents of each
class, those with the smallest hash of their id, read to the driver; classes are
weighted back to their true frequencies. Scoring reads every window of every
document, in one pass without a shuffle; what is broadcast is two dictionaries of
some kilobytes.

Defined results: null and empty texts score like a document with one window
without difference; rows without a label are only scored; of several labels
of a document, and of equal texts with different labels, the largest counts; without
texts of both classes, or without words that tell them apart, nothing can be told and
every score is 0; a null
doc_id is never used for learning; equal texts have equal scores; columns named like a
result give way to it; no documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm import words
from reckoner.llm.common import with_results

SAMPLE_ROWS = 4000
THRESHOLD = 0.3
CODE_BYTES = 3
WINDOW, OVERLAP = 96, 24
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 16_000, 6_000
LOG_ODDS, LEAST_SHARE = 3.0, 0.012
CONSPICUOUS = 9
CALIBRATION_FOLDS = 3

_WORD = re.compile(rb"[a-z\x80-\xff]+")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_CODE = np.random.default_rng(41).integers(0, 256, (1 << 16, CODE_BYTES), dtype=np.uint8)
_VALUE = np.random.default_rng(43).integers(1, 2**63, 256, dtype=np.uint64)


def coded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``CODE_BYTES`` bytes for each byte, from its word up to and with that byte."""
    lower = words._LOWER[data]
    n = len(lower)
    begin = ~_LETTER[lower]
    begin[1:] |= begin[:-1]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    at = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[lower] * words._power("up", n), out=total[1:])
    return _CODE[words.mix((total[1:] - total[at]) * words._power("down", n + 1)[at]) >> np.uint64(48)]


def _code(text: bytes) -> bytes:
    data = np.frombuffer(text, np.uint8)
    return coded(data, np.array([0, len(data)])).tobytes() if len(data) else b""


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer selects from the samples.

    Where they are too few for it: the different samples, frequent ones last (nearest
    to the text, where matches are cheapest), rare ones left out beyond ``size``.
    """
    if sum(map(len, samples)) > 4 * size and len(samples) > 20:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    often = Counter(samples)
    return b"".join(sorted(often, key=lambda x: (often[x], x)))[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: None if there is nothing to tell the classes apart.
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if len(model.weights):
            self.plain, self.marked = model.compressors()

    def differences(self, code: bytes) -> np.ndarray:
        """For each window of a coded document, the bytes that the toxic dictionary saves."""
        step, size = WINDOW * CODE_BYTES, (WINDOW + OVERLAP) * CODE_BYTES
        plain, marked = self.plain.compress, self.marked.compress
        parts = [code[i : i + size] for i in range(0, len(code), step)]
        return np.array([len(plain(x)) - len(marked(x)) for x in parts] or [0], float)

    def features(self, column: pa.Array) -> np.ndarray:
        data, offsets = words.utf8(column)
        out = np.zeros((len(column), 6))
        for a, b in words.slices(offsets):
            code = coded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if offsets[b] > offsets[a] else None
            for row in range(a, b):
                at, to = offsets[row] - offsets[a], offsets[row + 1] - offsets[a]
                d = self.differences(code[at:to].tobytes() if to > at else b"")
                d = np.maximum(d, 0)
                top = np.sort(d)[-3:]
                high = d >= CONSPICUOUS
                out[row] = (1, top[-1], top.mean(), d.mean(), np.log1p(high.sum()), high.mean())
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(self.model.weights):
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.model.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge-penalised logistic regression by Newton's method."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (w * (y - p)) - ridge * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _dictionaries(texts: list[str], labels: list[int]) -> tuple[bytes, bytes] | None:
    """Ordinary and toxic dictionary; None if texts of a class are missing or none tells."""
    split = [_WORD.findall(t.encode().lower()) for t in texts]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for w, y in zip(split, labels, strict=True):
        seen[y].update(set(w))
    n = len(labels) - sum(labels), sum(labels)
    if not n[0] or not n[1]:
        return None
    least = max(2 if n[1] < 100 else 3, LEAST_SHARE * n[1])
    telling = {w for w, k in seen[1].items() if k >= least and np.log((k + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1)) > LOG_ODDS}
    toxic, ordinary = [], []
    for all_words, y in zip(split, labels, strict=True):
        own = [w for w in all_words if w in telling] if y else all_words
        size = 8 if y else 32
        (toxic if y else ordinary).extend(_code(b" " + b" ".join(own[i : i + size]) + b" ") for i in range(0, len(own), size))
    return (_dictionary(ordinary, ORDINARY_BYTES), _dictionary(toxic, TOXIC_BYTES)) if toxic else None


def fit(texts: list[str], labels: list[int], totals: tuple[int, int]) -> Model:
    """A model of labelled texts; ``totals``: rows of label 0 and 1 that they stand for."""
    label: dict[str, int] = {}
    for t, y in zip(texts, labels, strict=True):
        label[t] = max(y, label.get(t, 0))
    apart = [t for t in label if zlib.crc32(t.encode()) // 7 % CALIBRATION_FOLDS == 0]
    seen = [t for t in label if zlib.crc32(t.encode()) // 7 % CALIBRATION_FOLDS]
    made = _dictionaries(seen, [label[t] for t in seen])
    if made is None or len({label[t] for t in apart}) < 2:
        # Too few rows to keep some apart.
        apart = list(label)
        made = _dictionaries(apart, list(label.values()))
    if made is None:
        return Model(b"", b"", np.zeros(0))
    model = Model(*made, np.zeros(1))
    x = Scorer(model).features(pa.array(apart, pa.string()))
    y = np.array([label[t] for t in apart], float)
    of_class = [max(1, len(y) - y.sum()), max(1, y.sum())]
    weight = np.where(y == 1, totals[1] / of_class[1], totals[0] / of_class[0]) * len(y) / max(1, sum(totals))
    model.weights = _logistic(x, y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: int = 2, folds: int = 4) -> Model:
    """A model of the labelled rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("_label") == y).orderBy(order, "doc_id").limit(sample_rows) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").where(F.col("text").isNotNull())
    # At most two times sample_rows documents.
    got = sorted(((r["doc_id"], r["text"], r["_label"]) for r in rows.collect()), key=lambda r: zlib.crc32(f"{r[0]} {r[1]}".encode()))
    return fit([r[1] for r in got], [r[2] for r in got], (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        scorer = Scorer(shared.value)

        def compute(column: pa.Array) -> dict[str, np.ndarray]:
            s = scorer.scores(column)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return compute

    return with_results(docs, work, "score double, predicted int", keep=keep)
