"""Nested JSON as tables of leaves: parsed, looked up by path, measured, and written again.

A leaf has document_id, pos (its order in the text), steps (".key" and "[index]" from the
root down), path (root and steps in one text), kind and value. Kinds are null, boolean,
number, string, and array and object for empty ones. Numbers keep their text: 1.10 stays
1.10. Neither depth nor width is limited: texts too deep for recursion are read token by token.

What is asked of whole documents (``digests``, ``templates``, ``meta_counts``) is found where a text is
read, so no row for each leaf leaves the task.

Defined results: a text that isn't JSON has no leaves, nor has a null one; of a key that
comes twice both leaves stay; extra columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_TOKEN = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]++|\\.)*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null))')
_LEAF = "pos long, path string, steps array<string>, kind string, value string"

Leaf = tuple[list[str], str, str | None]


class _Pairs(list):
    """The members of an object, a key that comes twice included."""


class _Number(str):
    """A number's text."""

    __slots__ = ()


def _no_number(word: str) -> None:
    raise ValueError(word)


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_float=_Number, parse_int=_Number, parse_constant=_no_number)
_WORDS = {True: ("boolean", "true"), False: ("boolean", "false"), None: ("null", None)}


def _whole(text: str) -> str:
    """Half a surrogate pair has no UTF-8."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def flat(text: str) -> list[Leaf] | None:
    """(steps, kind, value) of every leaf of a JSON text; None if it isn't one."""
    out: list[Leaf] = []
    said = _whole if "\\u" in text else str

    def walk(node: object, steps: list[str]) -> None:
        kind = type(node)
        if kind is str:
            out.append((steps, "string", said(node)))
        elif kind is _Number:
            out.append((steps, "number", str(node)))
        elif kind is _Pairs:
            if not node:
                out.append((steps, "object", "{}"))
            for k, x in node:
                walk(x, [*steps, "." + said(k)])
        elif kind is list:
            if not node:
                out.append((steps, "array", "[]"))
            for k, x in enumerate(node):
                walk(x, [*steps, f"[{k}]"])
        else:
            out.append((steps, *_WORDS[node]))

    try:
        walk(_DECODER.decode(text), [])
    except RecursionError:
        return _flat_by_token(text)
    except ValueError:
        return None
    return out


def _text(token: str) -> str:
    text = json.loads(token)
    return _whole(text) if "\\u" in token else text


def _flat_by_token(text: str) -> list[Leaf] | None:
    """The same of texts of any depth."""
    out: list[Leaf] = []
    steps: list[str] = []
    #: Of each open container: how many members it has before this one, or None for objects.
    open_: list[int | None] = []
    at, want = 0, "value"
    while at < len(text) and (m := _TOKEN.match(text, at)):
        at, (mark, string, number, word) = m.end(), m.groups()
        if want == "colon":
            if mark != ":":
                return None
            want = "value"
        elif want in ("key", "first key") and string:
            try:
                steps.append("." + _text(string))
            except ValueError:
                return None
            want = "colon"
        elif (want, mark) in (("first key", "}"), ("first value", "]")):
            open_.pop()
            if mark == "]":
                steps.pop()
            out.append((steps[:], "array" if mark == "]" else "object", "[]" if mark == "]" else "{}"))
            want = "next"
        elif want in ("value", "first value"):
            if mark == "{":
                open_.append(None)
                want = "first key"
                continue
            if mark == "[":
                open_.append(0)
                steps.append("[0]")
                want = "first value"
                continue
            if mark:
                return None
            try:
                value = _text(string) if string else number or word
            except ValueError:
                return None
            kind = "string" if string else "number" if number else "null" if word == "null" else "boolean"
            out.append((steps[:], kind, None if kind == "null" else value))
            want = "next"
        elif want == "next" and open_:
            steps.pop()
            n = open_[-1]
            if mark == ",":
                if n is not None:
                    open_[-1] = n + 1
                    steps.append(f"[{n + 1}]")
                want = "key" if n is None else "value"
            elif mark == ("}" if n is None else "]"):
                open_.pop()
            else:
                return None
        else:
            return None
    return out if want == "next" and not open_ and not text[at:].strip(" \t\n\r") else None


def built(leaves: Iterator[Leaf]) -> str:
    """The JSON text of leaves that stand in the order of a text."""
    out: list[str] = []
    before: list[str] = []
    for steps, kind, value in leaves:
        same = 0
        while same < min(len(before), len(steps)) - 1 and before[same] == steps[same]:
            same += 1
        if out:
            out += ["}" if s[0] == "." else "]" for s in reversed(before[same + 1 :])]
            out.append(",")
        for k in range(same, len(steps)):
            if k > same or not before:
                out.append("{" if steps[k][0] == "." else "[")
            if steps[k][0] == ".":
                out.append(json.dumps(steps[k][1:], ensure_ascii=False) + ":")
        out.append(json.dumps(value, ensure_ascii=False) if kind == "string" else "null" if kind == "null" else str(value))
        before = steps
    return "".join(out + ["}" if s[0] == "." else "]" for s in reversed(before)])


def leaves(docs: DataFrame, json: str = "json", root: str = "$", key: str = "document_id") -> DataFrame:
    """``key``, pos, path, steps, kind and value of every leaf of a JSON column, in Arrow batches."""
    out = T.StructType([docs.schema[key], *T.StructType.fromDDL(_LEAF)])
    arrow = to_arrow_schema(out)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, text in enumerate(batch.column(1).to_pylist()):
            for pos, (steps, kind, value) in enumerate(flat(text) or [] if text else []):
                yield i, pos, root + "".join(steps), steps, kind, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Few texts at a time, as a text may have many leaves.
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns = list(zip(*rows(batch), strict=True)) or [[]] * 6
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                rest = [pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), *rest], schema=arrow)

    return docs.select(key, json).mapInArrow(run, out)


def _by_document(docs: DataFrame, json: str, key: str, fields: str, of: Callable[[list[Leaf]], tuple]) -> DataFrame:
    """``key`` and ``fields``: what ``of`` gives for the leaves of each document that has some."""
    out = T.StructType([docs.schema[key], *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *of(have)) for i, text in enumerate(batch.column(1).to_pylist()) if text and (have := flat(text))]
            columns = list(zip(*found, strict=True)) or [[]] * len(arrow)
            ids = batch.column(0).take(pa.array(columns[0], pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True)]], schema=arrow)

    return docs.select(key, json).mapInArrow(run, out)


def digests(docs: DataFrame, json: str = "json", root: str = "$", key: str = "document_id") -> DataFrame:
    """``key``, n_leaves and leaves_md5: of the lines path=kind:value in the order of paths, those of nulls left out."""

    def of(have: list[Leaf]) -> tuple[int, str]:
        said = sorted((root + "".join(steps), f"{kind}:{value}") for steps, kind, value in have if value is not None)
        return len(have), hashlib.md5("\n".join(f"{path}={x}" for path, x in said).encode()).hexdigest()

    return _by_document(docs, json, key, "n_leaves long, leaves_md5 string", of)


_CACHED = 1 << 16


def _remembered(f: Callable) -> Callable:
    """``f`` with its results for the arguments met so far; all are dropped when they are too many."""
    had: dict = {}

    def get(x: object) -> object:
        if (y := had.get(x)) is None:
            if len(had) >= _CACHED:
                had.clear()
            y = had[x] = f(x)
        return y

    return get


def templates(docs: DataFrame, json: str = "json", root: str = "$") -> DataFrame:
    """template (a path with [] for each index), kind, n, and the least and most value, over all leaves."""
    out = T.StructType.fromDDL("template string, kind string, n long, least string, most string")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _remembered(lambda steps: re.sub(r"\[[0-9]+\]", "[]", root + "".join(steps)))
        for batch in batches:
            met: dict[tuple[str, str], list] = {}
            for text in batch.column(0).to_pylist():
                for steps, kind, value in flat(text) or [] if text else []:
                    if (x := met.get(at := (template(tuple(steps)), kind))) is None:
                        met[at] = [1, value, value]
                        continue
                    x[0] += 1
                    if value is not None:
                        if x[1] is None or value < x[1]:
                            x[1] = value
                        if x[2] is None or value > x[2]:
                            x[2] = value
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*at, *x) for at, x in met.items()], strict=True) if met else [[]] * 5, arrow, strict=True)], schema=arrow)

    found = docs.select(json).mapInArrow(run, out)
    return found.groupBy("template", "kind").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _role(steps: tuple[str, ...]) -> tuple[tuple[str, ...], str, int | None]:
    """Where the leaf of a report stands, what this part of it is ("", "value", "confidence", "evidence", "box", "meta"), and the evidence's number."""
    if "._meta" not in steps:
        return (steps[:-1], "value", None) if steps and steps[-1] == ".value" else (steps, "", None)
    cut = steps.index("._meta")
    part = "".join(steps[cut + 1 :])
    if found := re.match(r"\.evidence\[([0-9]+)\](\.bboxes)?", part):
        return steps[:cut], "box" if found[2] else "evidence", int(found[1])
    return steps[:cut], "confidence" if part == ".confidence" else "meta", None


def meta_counts(docs: DataFrame, json: str = "json", key: str = "document_id") -> DataFrame:
    """Of each document: n_leaves (written ones), n_wrapped, n_high, n_medium and n_low of these, n_evidence and n_grounded.

    The counts of ``with_meta`` without its rows.
    """
    role_of = _remembered(_role)

    def of(have: list[Leaf]) -> tuple[int, ...]:
        # Of each place: whether it is wrapped, its value's and its own (kind, value), confidence, evidence, and that with boxes.
        met: dict[str, list] = {}
        for steps, kind, value in have:
            base, role, n = role_of(tuple(steps))
            x = met.setdefault("".join(base), [False, None, None, None, None, None])
            if not role:
                x[2] = max(x[2] or (kind, value), (kind, value), key=_rank)
                continue
            x[0] = True
            # A value below metadata counts as one, too.
            if steps[-1] == ".value":
                x[1] = max(x[1] or (kind, value), (kind, value), key=_rank)
            if role == "confidence":
                x[3] = value if x[3] is None or value is not None and value > x[3] else x[3]
            elif n is not None:
                x[4] = (x[4] or set()) | {n}
                if role == "box" and kind not in ("null", "array"):
                    x[5] = (x[5] or set()) | {n}
        levels, rest = {"high": 0, "medium": 0, "low": 0}, [0, 0, 0, 0]
        for wrapped, inner, bare, level, evidence, boxed in met.values():
            leaf = inner or bare
            if leaf is None or wrapped and leaf[0] == "null":
                continue
            rest[0] += 1
            if wrapped:
                rest[1] += 1
                rest[2] += len(evidence or ())
                rest[3] += len(boxed or ())
                if (level := level or "low") in levels:
                    levels[level] += 1
        return rest[0], rest[1], *levels.values(), rest[2], rest[3]

    return _by_document(docs, json, key, "n_leaves long, n_wrapped long, n_high long, n_medium long, n_low long, n_evidence long, n_grounded long", of)


def _rank(leaf: tuple[str, str | None]) -> tuple[str, bool, str]:
    """The order of (kind, value), null first."""
    return leaf[0], leaf[1] is not None, leaf[1] or ""


def _place() -> Column:
    """What puts steps into an order in which members of a container stand together, by index."""
    return F.transform("steps", lambda s: F.when(F.startswith(s, F.lit("[")), F.concat(F.lit("["), F.lpad(F.regexp_extract(s, r"^\[([0-9]+)\]$", 1), 12, "0"))).otherwise(s))


def nested(leaf_table: DataFrame, key: str = "document_id", drop_null: bool = False) -> DataFrame:
    """``key`` and json: the inverse of ``leaves``, and the sink form of a report.

    Leaves are dealt by document, sorted, and written one behind the other as they come, so
    a task holds the text of one document. Without ``pos`` they stand by name and index.
    With ``drop_null``, members of objects that are null are left out.
    """
    rows = leaf_table.where(~((F.col("kind") == "null") & F.coalesce(F.startswith(F.try_element_at(F.col("steps"), F.lit(-1)), F.lit(".")), F.lit(False)))) if drop_null else leaf_table
    place = F.col("pos") if "pos" in leaf_table.columns else _place()
    rows = rows.select(key, place.alias("_place"), "steps", "kind", "value").repartition(key).sortWithinPartitions(key, "_place").select(key, "steps", "kind", "value")
    out = T.StructType([leaf_table.schema[key], T.StructField("json", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple]:
            now, have = None, []
            for batch in batches:
                for k, *leaf in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if have and k != now:
                        yield now, built(iter(have))
                        have = []
                    now = k
                    have.append(leaf)
            if have:
                yield now, built(iter(have))

        for k, text in texts():
            yield pa.RecordBatch.from_arrays([pa.array([k], arrow.field(0).type), pa.array([text], pa.string())], schema=arrow)

    return rows.mapInArrow(run, out)


def nodes(leaf_table: DataFrame, key: str = "document_id") -> DataFrame:
    """``key``, path, kind, value and n (an array's length) of every node of the trees, leaves and what is around them."""
    root = F.expr("substring(path, 1, length(path) - length(array_join(steps, '')))")
    each = F.transform(
        F.sequence(F.lit(1), F.size("steps")),
        lambda k: F.struct(F.concat(root, F.array_join(F.slice("steps", F.lit(1), k - 1), "")).alias("path"), F.element_at("steps", k).alias("next")),
    )
    inner = leaf_table.where(F.size("steps") > 0).select(key, F.inline(each))
    index = F.regexp_extract("next", r"^\[([0-9]+)\]$", 1).try_cast("long")
    inner = inner.groupBy(key, "path").agg(F.when(F.startswith(F.min("next"), F.lit("[")), "array").otherwise("object").alias("kind"), (F.max(index) + 1).alias("n"))
    own = leaf_table.select(key, "path", "kind", F.when(~F.col("kind").isin("array", "object"), F.col("value")).alias("value"), F.when(F.col("kind") == "array", F.lit(0).cast("long")).alias("n"))
    return inner.select(key, "path", "kind", F.lit(None).cast("string").alias("value"), F.when(F.col("kind") == "array", F.col("n")).alias("n")).unionByName(own)


def get_at(leaf_table: DataFrame, wanted: DataFrame, key: str = "document_id", root: str = "expense_report") -> DataFrame:
    """``key``, path, found, kind and value for each different (``key``, path) of ``wanted``.

    A node with a member "value" stands for that member; another node stands for itself
    (containers have no value); a path that leads nowhere isn't found. Paths may leave the
    root out.
    """
    asked = wanted.select(key, "path").distinct()
    full = F.when(F.startswith("path", F.lit(f"{root}.")), F.col("path")).otherwise(F.concat(F.lit(f"{root}."), "path"))
    tries = asked.select(key, "path", F.inline(F.array(F.struct(F.concat(full, F.lit(".value")).alias("_at"), F.lit(0).alias("_turn")), F.struct(full.alias("_at"), F.lit(1).alias("_turn")))))
    have = nodes(leaf_table, key).select(F.col(key).alias("_key"), F.col("path").alias("_at"), "kind", "value")
    met = tries.join(have.withColumnRenamed("_key", key), [key, "_at"], "left")
    best = F.min_by(F.struct("kind", "value"), F.when(F.col("kind").isNotNull(), F.col("_turn"))).alias("x")
    return met.groupBy(key, "path").agg(best).select(key, "path", F.col("x").isNotNull().alias("found"), "x.kind", "x.value")


def with_meta(leaf_table: DataFrame, key: str = "document_id") -> DataFrame:
    """``key``, path, kind, value and the metadata of every written leaf of a report.

    An object with "value" and "_meta" is one leaf: its confidence (low without one),
    needs_review, how many pieces of evidence it has, how many of them have boxes, and the
    origins and kinds they name. Other leaves are bare, without metadata. A wrapped leaf
    whose value is null is unknown and isn't there.
    """
    steps = F.col("steps")
    cut = F.array_position(steps, "._meta").cast("int")
    is_value = F.coalesce(F.try_element_at(steps, F.lit(-1)) == ".value", F.lit(False))
    # Where a wrapped leaf stands: what is before its "value" or "_meta".
    depth = F.when(cut > 0, cut - 1).when(is_value, F.size("steps") - 1)
    root = F.expr("substring(path, 1, length(path) - length(array_join(steps, '')))")
    base = F.concat(root, F.array_join(F.slice("steps", F.lit(1), depth), ""))
    part = F.when(cut > 0, F.array_join(F.slice("steps", cut + 1, F.size("steps")), ""))
    marked = leaf_table.select(key, "path", "kind", "value", "pos", cut.alias("_cut"), is_value.alias("_value"), F.coalesce(base, F.col("path")).alias("_base"), part.alias("_part"))
    piece = F.regexp_extract("_part", r"^\.evidence\[([0-9]+)\]", 1).try_cast("int")
    box = F.regexp_like("_part", F.lit(r"^\.evidence\[[0-9]+\]\.bboxes")) & (F.col("kind") != "null") & (F.col("kind") != "array")
    ends = lambda tail: F.regexp_like("_part", F.lit(rf"^\.evidence\[[0-9]+\]\.{tail}$"))
    of = lambda name, c: F.max(F.when(F.col("_part") == f".{name}", F.col(c)))
    wrapped = marked.groupBy(key, F.col("_base").alias("path")).agg(
        F.count_if(F.col("_cut") > 0).alias("_n_meta"),
        F.count_if(F.col("_value")).alias("_n_value"),
        F.max(F.when(F.col("_value"), F.struct("kind", "value"))).alias("_v"),
        F.max(F.when((F.col("_cut") == 0) & ~F.col("_value"), F.struct("kind", "value"))).alias("_bare"),
        F.coalesce(of("confidence", "value"), F.lit("low")).alias("confidence"),
        F.coalesce(of("needs_review", "value") == "true", F.lit(False)).alias("needs_review"),
        F.count_distinct(piece).alias("n_evidence"),
        F.count_distinct(F.when(box, piece)).alias("n_grounded"),
        F.array_sort(F.collect_set(F.when(ends("origin"), F.col("value")))).alias("origins"),
        F.array_sort(F.collect_set(F.when(ends("kind"), F.col("value")))).alias("evidence_kinds"),
        F.min("pos").alias("pos"),
    )
    is_wrapped = (F.col("_n_meta") > 0) | (F.col("_n_value") > 0)
    meta = [F.when(is_wrapped, F.col(c)).alias(c) for c in ("confidence", "needs_review", "n_evidence", "n_grounded", "origins", "evidence_kinds")]
    leaf = F.coalesce("_v", "_bare")
    out = wrapped.select(key, "path", leaf["kind"].alias("kind"), leaf["value"].alias("value"), is_wrapped.alias("wrapped"), *meta)
    return out.where(F.col("kind").isNotNull() & ~(F.col("wrapped") & (F.col("kind") == "null")))


def written_confidences(meta_table: DataFrame, key: str = "document_id") -> DataFrame:
    """n_high, n_medium and n_low over all written leaves of each document."""
    level = lambda x: F.count_if(F.col("confidence") == x).alias(f"n_{x}")
    return meta_table.where("wrapped").groupBy(key).agg(level("high"), level("medium"), level("low"))


def grounded_evidence(meta_table: DataFrame, key: str = "document_id") -> DataFrame:
    """n_evidence and n_grounded (with boxes) over all leaves of each document."""
    return meta_table.groupBy(key).agg(F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("n_evidence"), F.coalesce(F.sum("n_grounded"), F.lit(0)).alias("n_grounded"))
