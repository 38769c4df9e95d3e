"""Edits, undos and deletions of lines, one after the other, as a state machine per report.

Each action is judged against the state after the one before, so this is a fold and no
aggregate. Actions and the leaves to begin with are dealt by report and sorted (leaves,
then actions by time and id) and pass a task in that order: it keeps the tree of one report
and at most ``HISTORY`` undoable edits, never the actions of a report, however many. What an action
says is read beforehand, by built-in functions: its value as a boolean, a number and a text, the
catalogue's type of its path and whether the text is allowed there.

* An edit's path must begin with ``expense_report.`` and lead to a node. Only a last name may be
  missing, in an object that is there, and only if the catalogue knows the path. The type of
  the old value decides how the new text is read; where there is none (null, an empty text,
  a container) the catalogue's. Blank text is null. A container that is edited is replaced.
* An undo takes back the newest edit in the history, and puts its old value there.
* A deleted line takes its leaves with it, later lines move up, and the history is cleared.
* After each of these the report's total and first date are set from its lines, if any has one.

Defined results: an action of another kind, or with a null path or text, is rejected; rows
without a report form one; equal times go by event_id; a report without leaves is an empty
object; columns besides those named aren't read; no actions leave the leaves as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reckoner.functions import scalars as S

HISTORY = 20
ROOT = "expense_report"
LINES = f"{ROOT}.transaction_lines"
TOTAL, FIRST = f"{ROOT}.transaction_summary.total_usd", f"{ROOT}.transaction_summary.transaction_date"
# Fixed value: the metadata of a leaf that an edit makes.
EDIT_META = '{"confidence":"high","confidence_reason":"Edited by FA in the workbench.","evidence":[{"kind":"user_input","origin":"fa_workbench_edit"}],"needs_review":false,"flags":[]}'
# Why actions are rejected.
BAD_PREFIX, NO_TEXT, UNRESOLVED = "invalid path", "value must be a string", "path did not resolve"
NO_UNDO, STALE_UNDO, OUT_OF_RANGE = "nothing to undo", "history entry's path no longer resolves", "line index out of range"
NOT_BOOLEAN, NOT_NUMBER = "must be yes or no", "must be a number (e.g. 32.50)"

_OUT = "what string, event_id long, n long, action string, path string, outcome string, kind string, old_value string, value string, meta string, n_lines long, total_usd double, undoable long"

#: kind, value and metadata; metadata is null for a bare leaf, and "" for a wrapped one without any.
Leaf = tuple[str, str | None, str | None]
_NULL: Leaf = ("null", None, None)


@functools.lru_cache(maxsize=1 << 16)
def _above(path: str) -> tuple[tuple[str, str], ...]:
    """Each node around a path, with the sign that its members' names begin with."""
    return tuple((path[:k], path[k]) for k in range(1, len(path)) if path[k] in ".[")


class State:
    """A report's leaves, how many are in each node around them, and its undoable edits."""

    def __init__(self) -> None:
        self.leaves: dict[str, Leaf] = {}
        self.inside: dict[str, tuple[int, str]] = {}
        self.history: list[tuple[str, dict[str, Leaf], str | None]] = []

    def put(self, path: str, leaf: Leaf) -> None:
        if path not in self.leaves:
            for node, sign in _above(path):
                self.inside[node] = (self.inside.get(node, (0, sign))[0] + 1, sign)
                # What has a member is no empty container.
                if self.leaves.get(node, _NULL)[0] in ("object", "array"):
                    self.take(node)
        self.leaves[path] = leaf

    def take(self, path: str) -> None:
        del self.leaves[path]
        for node, sign in _above(path):
            n = self.inside[node][0] - 1
            if n:
                self.inside[node] = (n, sign)
            else:
                del self.inside[node]

    def below(self, path: str) -> dict[str, Leaf]:
        """The leaf at a path, or all below it."""
        if path in self.leaves:
            return {path: self.leaves[path]}
        return {p: x for p, x in self.leaves.items() if p.startswith(path) and p[len(path) : len(path) + 1] in (".", "[")}

    def n_lines(self) -> int:
        n = 0
        while self.has(f"{LINES}[{n}]"):
            n += 1
        return n

    def has(self, path: str) -> bool:
        return path in self.leaves or path in self.inside

    def resolve(self, path: str, parent: str | None, known: bool) -> str | None:
        """The node that a path leads to; ``parent`` is what is before its last name (null: its last step is an index)."""
        if self.has(path):
            return path
        if path.endswith(".value") and self.leaves.get(path[:-6], _NULL)[2] is not None:
            return path[:-6]
        if parent is None or not known:
            return None
        is_object = parent == ROOT or self.inside.get(parent, (0, ""))[1] == "." or self.leaves.get(parent, _NULL)[0] == "object"
        return path if is_object else None

    def set(self, path: str, kind: str, value: str | None) -> None:
        old = self.leaves.get(path)
        if old is None:
            if path in self.inside:
                for p in self.below(path):
                    self.take(p)
                self.put(path, (kind, value, None))
            else:
                self.put(path, (kind, value, EDIT_META))
        else:
            self.leaves[path] = (kind, value, old[2])

    def edit(self, r: dict) -> tuple[str, str | None, str | None]:
        """(outcome, kind, old value)."""
        path, text = r["path"], r["text"]
        if path is None or not path.startswith(f"{ROOT}."):
            return BAD_PREFIX, None, None
        if text is None:
            return NO_TEXT, None, None
        at = self.resolve(path, r["parent"], r["type"] is not None) if r["well_formed"] else None
        if at is None:
            return UNRESOLVED, None, None
        old = self.leaves.get(at, _NULL)
        use = old[0] if old[0] in ("boolean", "number") or old[0] == "string" and old[1] else r["type"]
        kind, value, why = "string", text or None, None
        if use == "boolean":
            kind, value, why = "boolean", r["as_boolean"], NOT_BOOLEAN if r["no_boolean"] else None
        elif use == "number":
            kind, value, why = "number", r["as_number"], NOT_NUMBER if r["no_number"] else None
        elif value is not None:
            why = r["not_allowed"]
        if why:
            return why, None, None
        self.history = [*self.history, (path, self.below(at), value)][-HISTORY:]
        self.set(at, kind if value is not None else "null", value)
        self.sum_up()
        return "ok", kind if value is not None else "null", old[1]

    def undo(self) -> tuple[str, str | None, str | None, str | None]:
        """(outcome, path, value taken back, value put there)."""
        if not self.history:
            return NO_UNDO, None, None, None
        path, old, _ = self.history.pop()
        at = self.resolve(path, None, False)
        if at is None:
            return STALE_UNDO, path, None, None
        gone = self.leaves.get(at, _NULL)
        if old and at not in old:
            for p in self.below(at):
                self.take(p)
            for p, x in old.items():
                self.put(p, x)
        else:
            self.set(at, *old.get(at, _NULL)[:2])
        self.sum_up()
        return "ok", path, gone[1], old.get(at, _NULL)[1]

    def delete_line(self, k: int | None) -> str:
        n = self.n_lines()
        if k is None or not 0 <= k < n:
            return OUT_OF_RANGE
        for p in self.below(f"{LINES}[{k}]"):
            self.take(p)
        for i in range(k + 1, n):
            for p, x in self.below(f"{LINES}[{i}]").items():
                self.take(p)
                self.put(f"{LINES}[{i - 1}]{p[len(f'{LINES}[{i}]') :]}", x)
        if n == 1:
            self.put(LINES, ("array", "[]", None))
        self.sum_up()
        self.history = []
        return "ok"

    def sum_up(self) -> None:
        common = [f"{LINES}[{i}].common" for i in range(self.n_lines())]
        amounts = [float(x[1]) for c in common if (x := self.leaves.get(f"{c}.line_amount_usd", _NULL))[0] == "number"]
        dates = [x[1] for c in common if (x := self.leaves.get(f"{c}.date", _NULL))[0] == "string" and x[1]]
        for path, found, kind, value in ((TOTAL, amounts, "number", round(sum(amounts), 2)), (FIRST, dates, "string", min(dates, default=None))):
            if found:
                text = str(value).removesuffix(".0") if kind == "number" else value
                self.put(path, (kind, text, self.leaves.get(path, ("", None, ""))[2]))

    def total(self) -> float | None:
        kind, value, _ = self.leaves.get(TOTAL, _NULL)
        return float(value) if kind == "number" else None


def _fold(rows: Iterator[dict]) -> Iterator[dict]:
    """A row for each action, and at a report's end one for each leaf and one for what can be undone."""
    state, now, n = State(), None, 0

    def end() -> Iterator[dict]:
        for path, (kind, value, meta) in state.leaves.items():
            yield {"report_id": now, "what": "leaf", "path": path, "kind": kind, "value": value, "meta": meta}
        path, old, value = state.history[-1] if state.history else (None, {}, None)
        yield {"report_id": now, "what": "undo", "path": path, "old_value": next(iter(old.values()), _NULL)[1] if len(old) == 1 else None, "value": value, "undoable": len(state.history), "n": n, "n_lines": state.n_lines(), "total_usd": state.total()}

    started = False
    for r in rows:
        if not started or r["report_id"] != now:
            if started:
                yield from end()
            state, now, n, started = State(), r["report_id"], 0, True
        if r["phase"] == 0:
            state.put(r["path"], (r["kind"], r["text"], r["meta"]))
            continue
        out = {"report_id": now, "what": "action", "event_id": r["event_id"], "n": n, "action": r["action"], "path": r["path"]}
        n += 1
        if r["action"] == "edit":
            out["outcome"], out["kind"], out["old_value"] = state.edit(r)
            if out["outcome"] == "ok":
                out["value"] = state.history[-1][2]
        elif r["action"] == "undo":
            out["outcome"], out["path"], out["old_value"], out["value"] = state.undo()
        elif r["action"] == "delete_line":
            out["outcome"] = state.delete_line(r["line_idx"])
        else:
            out["outcome"] = "unknown action"
        yield out | {"n_lines": state.n_lines(), "total_usd": state.total(), "undoable": len(state.history)}
    if started:
        yield from end()


def _stream(actions: DataFrame, leaves: DataFrame, field_types: DataFrame) -> DataFrame:
    """Leaves and actions as one table in the order of the fold."""
    path, text = F.col("path"), F.trim("new_text")
    b, x = S.coerce_bool(text), S.coerce_number(text)
    types = field_types.select(F.col("template").alias("_template"), F.coalesce("type", F.lit("string")).alias("type"), "allowed")
    # The catalogue is joined as Spark chooses: it checks its size.
    known = actions.withColumn("_template", S.path_template(path)).join(types, "_template", "left")
    parent = F.when(~path.rlike(r"\]\z"), F.regexp_extract(path, r"(?s)^(.*)\.[^.]*\z", 1))
    acts = known.select(
        "report_id", F.lit(1).alias("phase"), "ts", "event_id", "action", "path", text.alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("meta"),
        F.col("line_idx").cast("long").alias("line_idx"), S.path_steps(path).isNotNull().alias("well_formed"), parent.alias("parent"), "type",
        b["value"].cast("string").alias("as_boolean"), b["error"].alias("no_boolean"), S.shown_number(x["value"]).alias("as_number"), x["error"].alias("no_number"),
        F.when(F.col("allowed").isNotNull(), S.validate_enum(text, F.col("allowed"))).alias("not_allowed"),
    )
    meta = F.col("meta") if "meta" in leaves.columns else F.lit("")
    first = leaves.select("report_id", F.lit(0).alias("phase"), "path", F.col("value").alias("text"), "kind", meta.alias("meta"))
    return first.unionByName(acts, allowMissingColumns=True)


def replay(actions: DataFrame, leaves: DataFrame, field_types: DataFrame) -> DataFrame:
    """The whole fold as one table: see ``log``, ``leaves_after`` and ``undo_available``.

    ``actions``: report_id, ts, event_id, action ("edit", "undo" or "delete_line"), path,
    new_text, line_idx. ``leaves``: report_id, path, kind, value and, if known, meta (null:
    bare). ``field_types``: template, type, allowed.
    """
    stream = _stream(actions, leaves, field_types)
    order = ["report_id", "phase", "ts", "event_id", "path", "text"]
    dealt = stream.repartition("report_id").sortWithinPartitions(*order)
    out = T.StructType([actions.schema["report_id"], *T.StructType.fromDDL(_OUT)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        have: list[dict] = []
        for r in _fold(rows):
            have.append(r)
            if len(have) == 4096:
                yield pa.RecordBatch.from_pylist(have, schema=arrow)
                have = []
        yield pa.RecordBatch.from_pylist(have, schema=arrow)

    return dealt.mapInArrow(run, out)


def log(folded: DataFrame) -> DataFrame:
    """Each action with its outcome ("ok" or why not), values before and behind, and the report's figures then."""
    return folded.where("what = 'action'").select("report_id", "event_id", "n", "action", "path", "outcome", "old_value", "value", "n_lines", "total_usd", "undoable")


def leaves_after(folded: DataFrame) -> DataFrame:
    """report_id, path, kind, value and meta of every leaf at the end."""
    return folded.where("what = 'leaf'").select("report_id", "path", "kind", "value", "meta")


def undo_available(folded: DataFrame) -> DataFrame:
    """Whether each report has an edit to undo, and which."""
    return folded.where("what = 'undo'").select("report_id", (F.col("undoable") > 0).alias("available"), "path", "old_value", F.col("value").alias("new_value"), "undoable")
