"""Spelling variants, personal data and hard negatives against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.llm import negatives, pii, queries, spelling

LOWER = str.maketrans(queries.UPPER, queries.LOWER)


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n: dict[str, int], ratio: int = 10) -> set[tuple]:
    near = {w: [v for v in n if one_apart(w, v)] for w in n}

    def form(w):
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        return best if best is not None and n[best] >= ratio * n[w] else None

    out = set()
    for w in n:
        f = root = form(w)
        while root is not None and form(root) is not None:
            root = form(root)
        out.add((w, f, w if root is None else root, n[w], len(near[w]), None if f is None else n[f]))
    return out


@pytest.mark.parametrize(("letters", "longest", "seed"), [("ab", 6, 1), ("abé", 5, 2), ("abcdefghij", 3, 3), ("ab🙂", 4, 4)])
def test_variants_match_brute_force(spark, letters, longest, seed):
    r = random.Random(seed)
    n = {"".join(r.choice(letters) for _ in range(r.randint(0, longest))): r.choice([1, 2, 3, 30, 400, 5000]) for _ in range(150)}
    rows = [(w, c, "x") for w, c in n.items()] + [(None, 5, "x")]
    found = spelling.variants(spark.createDataFrame(rows, "word string, n long, id string")).collect()
    assert {tuple(x) for x in found} == brute_variants(n) and len(found) == len(n)


def test_variants_of_repeated_and_very_long_words(spark):
    long = "ab" * 100_000
    rows = [("colour", 40), ("colour", 60), ("color", 3), (long, 2), (long + "a", 50), ("lone", None)]
    got = {r["word"]: (r["form"], r["n"], r["n_near"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"colour": (None, 100, 1), "color": ("colour", 3, 1), long: (long + "a", 2, 1), long + "a": (None, 50, 1), "lone": (None, 0, 0)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_nodes_are_the_same_number_in_every_range():
    r = random.Random(7)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(900)})
    for cuts in ([0, 1, 2, 3, 100, 101, 190], [0], list(range(0, len(words), 7))):
        heads = [words[c] for c in cuts]
        number, seen = {}, {}
        for at, (a, b) in enumerate(itertools.pairwise([*cuts, len(words)])):
            for word, nodes in zip(words[a:b], spelling.walk(iter(words[a:b]), heads, at, at), strict=True):
                for k, x in enumerate(nodes):
                    assert number.setdefault(word[:k], x) == x and seen.setdefault(x, word[:k]) == word[:k]


def test_spelling_query_on_odd_documents(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["receipts", "statement", "Éclairées", "transport", "mileages", "travellerss"]
    texts = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300)))) for k in range(60)]
    texts += [(None, "receipts Receipts"), (70, None), (71, ""), (71, "statement-statement"), (71, "statement"), (72, "ÀÉÀÉÀÉÀÉ x" * 5), (73, "transport" * 3000)]
    spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    n = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    got = queries.op11_spelling_variants(spark, str(tmp_path)).collect()
    want = brute_variants({w: c for w, c in n.items() if c >= 2 and len(w) >= 7})
    assert {tuple(x) for x in got} == want and any(f for _, f, *_ in want)


def plain_base(t: str) -> list[tuple[str, list[tuple[int, int]]]]:
    digits = lambda x: re.sub("[^0-9]", "", x)
    spans = lambda pattern, test: [m.span() for m in re.finditer(pattern, t) if test(m[0])]
    return [
        ("email", spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True)),
        ("ip", spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split(".")))),
        ("card", spans(r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and pii.luhn(digits(x)))),
        ("phone", spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15)),
    ]


def test_base_spans_match_the_patterns():
    r, found = random.Random(1), 0
    for k in range(20000):
        t = "".join(r.choice(["0123401 -.+@ab(", "a@.b-% @.", "4929111111111111 0-"][k % 3]) for _ in range(r.randint(0, 40)))
        for kind, want in plain_base(t):
            got = [(s["start"], s["end"]) for s in pii.spans_of(t) if s["kind"] == kind]
            assert got == want, (t, kind)
            found += len(got)
    assert found > 1000


def test_checksums_and_context():
    kinds = lambda t: [(s["kind"], t[s["start"] : s["end"]], s["score"]) for s in pii.spans_of(t)]
    assert pii.luhn("4929000000006") and not pii.luhn("4929000000007")
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 AND SO ON") == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert kinds("GB83 WEST 1234 5698 7654 32") == [] and kinds("123-45-6789") == []
    assert kinds("her social security number 123-45-6789") == [("ssn", "123-45-6789", 0.55)]
    assert kinds("order 123-45-6789 ssn") == [] and kinds("ssn 000-45-6789") == []
    (near,), (far,), (against,) = (kinds(f"{word} 4111 1111 1111 1111") for word in ("card", "x", "tracking"))
    assert near[2] > far[2] > against[2] > 0


def test_personal_data_query(spark, tmp_path):
    texts = [None, "", "a.b@c.de, 10.0.0.1 and +1 (017) 555-7713", "é🙂 4111-1111-1111-1111 x@y", "GB82WEST12345698765432", "1" * 300_000, "a@" * 100_000, "1.2.3.4 " * 5000]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(None, "me@x.org", 0), (2, texts[2], 0)]
    spark.createDataFrame(rows, "doc_id long, text string, pii int").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = queries.op12_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and time.time() - began < 60
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        base = plain_base(t or "") if len(t or "") < 10**5 else [("email", []), ("ip", []), ("card", []), ("phone", [])]
        order = sorted((a, k, f"{kind}:{a}:{b}") for k, (kind, spans) in enumerate(base) for a, b in spans)
        written = ",".join(x[2] for x in order)
        r = by_id[i]
        assert [r[f"n_{k}"] for k, _ in base] == [len(s) for _, s in base]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert r["spans"] == (written or ("iban:0:22" if i == 4 else ""))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0
    hidden = pii.redacted(spark.createDataFrame(rows[2:4], "doc_id long, text string, n int")).orderBy("doc_id").collect()
    assert [r["redacted"] for r in hidden] == ["[email], [ip] and [phone]", "é🙂 [card] x@y"]


def brute_negatives(rows, anchor):
    """rows of (id, label, vector or None)."""
    usable = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, done = [], set()
    for at, (i, label, v) in enumerate(usable):
        if not anchor(i) or (i, label, tuple(v)) in done:
            continue
        done.add((i, label, tuple(v)))
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, same) for k, (j, same, w) in enumerate(usable) if k != at)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            some = [(t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(some, 1)]
    return sorted(out)


def negative_rows(seed: int, n: int, kind: str) -> list[tuple]:
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 6)).round(3 if kind == "ties" else 9)
    if kind == "ties":
        v = v[r.integers(0, 12, n)]
    if kind == "large":
        v = v * 1e5
    if kind == "huge":
        v = v * 1e6
    v[:3] = np.abs(v[:3])
    label = r.integers(0, 3, n)
    label[: n // 2] = 1
    return [(int(k), int(x), [float(y) for y in w]) for k, (x, w) in enumerate(zip(label, v, strict=True))]


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "huge"])
def test_negatives_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "GATHERED", 64)
    rows = negative_rows(5, 240, kind)
    rows += [(300, None, [1.0] * 6), (400, 1, None), (500, 1, [1.0, None] * 3), (10, 1, [float("nan")] * 6), (20, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    # Rows that share an id, and one that is there twice.
    rows += [(30, 1, rows[30][2]), (31, 2, rows[33][2]), (600, 1, rows[7][2]), (600, 2, rows[8][2])]
    spread = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, label int, vector array<double>, score string").repartition(5)
    got = negatives.mine(spread, F.col("vec_id") % 10 == 0, block=16)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 50


def test_negatives_of_odd_tables(spark):
    kind = "vec_id long, label int, vector array<float>"
    mine = lambda rows: [tuple(x) for x in negatives.mine(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()]
    assert mine([]) == [] and mine([(1, 1, [1.0])]) == [] and mine([(0, 1, [1.0])]) == []
    # A missing component counts as 0; scores of 0 have a window of 0; below it there is none.
    assert mine([(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 0, [0.9, 0.0, 7.0])]) == [(0, 1, 1, 2, 65536, 58880)]
    assert mine([(0, 1, [1.0]), (1, 1, [0.0]), (2, 0, []), (3, 0, [0.5])]) == [(0, 1, 1, 2, 0, 0)]
    assert mine([(0, 1, [1.0]), (1, 1, [-1.0]), (2, 0, [-1.0])]) == []
