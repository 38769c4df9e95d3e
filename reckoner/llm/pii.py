"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Base kinds are email, ip, card and phone: the leftmost, non-overlapping matches of fixed
patterns that pass their check (parts of an address up to 255, the Luhn sum of a card,
the number of digits). The method adds two kinds: iban, confirmed by its remainder
modulo 97, and ssn, which has no checksum and so needs a word of context. Every span has
a score: that of its kind, raised where a word of the kind stands near it and lowered
where a word stands near that speaks for another kind of number. Added spans need
``least``; base spans stay whatever their score is. Spans of different kinds may overlap.

Each text is searched whole and in time linear in its length: candidates are found by
their sign (an at-sign, a plus, runs of digits), and then measured from there; what a
pattern would match from a later start inside such a run isn't tried again and again.
Rows keep their partition; nothing is shuffled.

Defined results: a null or empty text has no spans; offsets count code points, ends
exclusive; repeated rows are answered each on its own; extra columns pass through if
kept; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import with_results

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
LEAST = 0.5
#: Code points before and behind a span that its context words may stand in.
NEAR = 48

START = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISED, LOWERED = 0.25, -0.25
WORDS = {
    "email": "email mail e-mail contact write correo courriel kontakt",
    "ip": "ip host server address addr client login",
    "card": "card credit debit visa mastercard amex payment tarjeta carte karte",
    "phone": "phone tel telephone mobile cell call fax teléfono téléphone telefon",
    "iban": "iban bank account transfer konto cuenta compte",
    "ssn": "ssn social security taxpayer",
}
AGAINST = {
    "ip": "version release build section chapter",
    "card": "order invoice tracking isbn serial part",
    "phone": "order invoice tracking isbn serial part",
    "iban": "order invoice tracking serial part",
    "ssn": "order invoice tracking serial part",
}
_RAISE = {k: frozenset(v.split()) for k, v in WORDS.items()}
_LOWER = {k: frozenset(v.split()) for k, v in AGAINST.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9.-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9][\x20 0-9-]*+")
_GAP = re.compile(r"[\x20-]{2,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without spaces has the remainder 1."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    No class of the pattern holds an at-sign, so each match has one, and begins with the
    run before it, or where the match before it ended.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            labels = m[0].partition("..")[0].rstrip(".")
            if "." in labels and labels[0] != ".":
                done = after = at + 1 + len(labels)
                yield start, done
        at = text.find("@", after)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[0-9]([\\x20-]?[0-9])+`` with 12 to 19 digits and a Luhn sum of 0."""
    for m in _DIGITS.finditer(text):
        begin, end = m.span()
        if end - begin < 12:
            continue
        for cut in [*_GAP.finditer(text, begin, end), None]:
            run = text[begin : cut.start() if cut else end].rstrip(" -")
            digits = _NO_DIGIT.sub("", run)
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield begin, begin + len(run)
            begin = cut.end() if cut else end


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        # Words in capitals behind a number match too: the longest beginning that is valid counts.
        ends = [i for i in range(len(m[0]), 14, -1) if i == len(m[0]) or m[0][i] == " "]
        for n in ends:
            code = m[0][:n].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), m.start() + n
                break


def social(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones, accounts, social), strict=True))


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    words = set(_WORD.findall(around))
    score = START[kind] + RAISED * bool(words & _RAISE[kind]) + LOWERED * bool(words & _LOWER.get(kind, frozenset()))
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str | None, least: float = LEAST) -> list[dict[str, object]]:
    """kind, start, end, score and base of every span, by start and kind as in ``KINDS``."""
    found = []
    for rank, kind in enumerate(KINDS):
        base = kind in BASE_KINDS
        for start, end in _FINDERS[kind](text or ""):
            score = _score(text, kind, start, end)
            if base or score >= least:
                found.append((start, rank, {"kind": kind, "start": start, "end": end, "score": score, "base": base}))
    return [x[-1] for x in sorted(found, key=lambda x: x[:2])]


def find(docs: DataFrame, least: float = LEAST, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pii``, an array of kind, start, end, score and base."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def work():
        return lambda column: {"pii": pa.array([spans_of(x.as_py(), least) for x in column], kind)}

    return with_results(docs, work, "pii array<struct<kind:string,start:long,end:long,score:double,base:boolean>>", text=text, keep=keep)


def written(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping ones as one,
    named by the first."""

    def hidden(x: str | None) -> str | None:
        out, at = [], 0
        for s in spans_of(x, least):
            if s["start"] >= at:
                out += [x[at : s["start"]], f"[{s['kind']}]"]
            at = max(at, s["end"])
        return x if x is None else "".join(out) + x[at:]

    def work():
        return lambda column: {"redacted": pa.array([hidden(x.as_py()) for x in column], pa.string())}

    return with_results(docs, work, "redacted string", text=text)
