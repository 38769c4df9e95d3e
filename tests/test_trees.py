"""Trees of leaves and edits one by one, against nested objects in plain Python."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import replay, tree
from reckoner.sources import catalog

META = json.loads(replay.EDIT_META)
TYPES = {f"expense_report.{p}": k for p, k in catalog.FIELD_TYPES.items()}
ALLOWED = {f"expense_report.{p}": v for p, v in catalog.ALLOWED_VALUES.items()}


def random_value(r, depth=0):
    k = r.random()
    if depth < 4 and k < 0.35:
        return {r.choice(["a", "b.c", "d[0]", 'é"x', "", "value", "_meta"]): random_value(r, depth + 1) for _ in range(r.randint(0, 3))}
    if depth < 4 and k < 0.6:
        return [random_value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, 1.5, -2e10, True, False, None, "x", 'é🙂\n"', ""])


def test_texts_and_leaves_are_inverse(spark):
    r = random.Random(1)
    values = [random_value(r) for _ in range(3000)]
    texts = [json.dumps(x, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for x in values]
    assert all(json.loads(tree.built(iter(tree.flat(t)))) == x for t, x in zip(texts, values, strict=True))
    for bad in ["", "{", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", "1 2", "01", "nul", '"a', "[1}", '{"a":1,}', "{1:2}", "'a'", "[,1]", "]", '"\\x"']:
        assert tree.flat(bad) is None
    rows = [(k, t, "x") for k, t in enumerate(texts[:300])] + [(1000, None, "x"), (1001, "{bad", "x"), (None, '{"n": 1.10}', "x"), (1002, "[" * 500 + "1.10" + "]" * 500, "x")]
    docs = spark.createDataFrame(rows, "document_id long, json string, path string").repartition(5)
    found = tree.leaves(docs)
    got = {x["document_id"]: json.loads(x["json"]) for x in tree.nested(found.repartition(3)).collect()}
    deep = got.pop(1002)
    assert got.pop(None) == {"n": 1.1} and got == dict(enumerate(values[:300]))
    while isinstance(deep, list):
        (deep,) = deep
    assert deep == 1.1 and found.where("document_id = 1002").first()["value"] == "1.10"
    assert tree.leaves(docs.limit(0)).count() == 0 and tree.nested(found.limit(0)).count() == 0


def test_order_by_index_and_dropped_nulls(spark):
    rows = [("a", [".x", f"[{k}]", ".n"], "number", str(k)) for k in (10, 2, 1, 0, 3, 4, 5, 6, 7, 8, 9, 11)] + [("a", [".y"], "null", None), ("a", [".x", "[0]", ".z"], "null", None)]
    leaves = spark.createDataFrame(rows, "document_id string, steps array<string>, kind string, value string")
    assert [json.loads(x["json"]) for x in tree.nested(leaves, drop_null=True).collect()] == [{"x": [{"n": k} for k in range(12)]}]


def wrap(value, **meta):
    return {"value": value, "_meta": {"confidence": "high", "evidence": [], **meta}}


def leaves_of(spark, reports):
    docs = spark.createDataFrame([(k, json.dumps(x)) for k, x in reports.items()], "report_id long, json string")
    return tree.leaves(docs, root="expense_report", key="report_id")


def test_fields_by_path(spark):
    report = {"authorized_by": "me", "transaction_lines": [{"common": {"date": wrap("2024-01-01"), "tip": wrap(None)}}, {}], "n": {"value": {"deep": [1, 2]}}, "list": [5, [6]]}
    want = {
        "expense_report.authorized_by": (True, "string", "me"), "authorized_by": (True, "string", "me"), "expense_report.transaction_lines[0].common.date": (True, "string", "2024-01-01"),
        "transaction_lines[0].common.date._meta.confidence": (True, "string", "high"), "transaction_lines[0].common.tip": (True, "null", None), "transaction_lines": (True, "array", None), "transaction_lines[1]": (True, "object", None),
        "transaction_lines[0].common": (True, "object", None), "n": (True, "object", None), "list[1][0]": (True, "number", "6"), "transaction_lines[2]": (False, None, None), "transaction_lines[0].common.none": (False, None, None), "nothing.at.all": (False, None, None), "list[x]": (False, None, None),
    }
    leaves = leaves_of(spark, {1: report, 2: {}})
    wanted = spark.createDataFrame([(1, p) for p in want] + [(2, "authorized_by"), (3, "n")], "report_id long, path string")
    got = {(x["report_id"], x["path"]): (x["found"], x["kind"], x["value"]) for x in tree.get_at(leaves, wanted, "report_id").collect()}
    assert got == {**{(1, p): x for p, x in want.items()}, (2, "authorized_by"): (False, None, None), (3, "n"): (False, None, None)}
    arrays = {x["path"]: x["n"] for x in tree.nodes(leaves, "report_id").where("kind = 'array' and report_id = 1").collect()}
    assert arrays["expense_report.transaction_lines"] == 2 and arrays["expense_report.list"] == 2 and arrays["expense_report.transaction_lines[0].common.date._meta.evidence"] == 0


def test_metadata_of_leaves(spark):
    proof = [{"kind": "document", "bboxes": [[0.1, 0.2, 0.3, 0.4]], "origin": "a"}, {"kind": "document", "bboxes": None}, {"kind": "system_generated", "origin": "reduce.total_usd"}]
    report = {"x": wrap(5, evidence=proof, needs_review=True), "y": {"value": "t", "_meta": {"confidence": "medium"}}, "z": wrap(None), "w": {"value": 1}, "bare": "b", "deep": [{"v": wrap(False, confidence="low")}]}
    got = {r["path"][15:]: r for r in tree.with_meta(leaves_of(spark, {7: report}), "report_id").collect()}
    assert set(got) == {"x", "y", "w", "bare", "deep[0].v"}
    assert (got["x"]["confidence"], got["x"]["needs_review"], got["x"]["n_evidence"], got["x"]["n_grounded"], got["x"]["origins"], got["x"]["evidence_kinds"]) == ("high", True, 3, 1, ["a", "reduce.total_usd"], ["document", "system_generated"])
    assert (got["w"]["confidence"], got["w"]["wrapped"], got["bare"]["wrapped"], got["bare"]["confidence"], got["deep[0].v"]["value"]) == ("low", True, False, None, "false")
    meta = tree.with_meta(leaves_of(spark, {7: report, 8: {}}), "report_id")
    assert [tuple(r) for r in tree.written_confidences(meta, "report_id").collect()] == [(7, 1, 1, 2)]
    assert sorted(tuple(r) for r in tree.grounded_evidence(meta, "report_id").collect()) == [(7, 3, 1), (8, 0, 0)]


class Plain:
    """Edits of a nested report, step by step."""

    def __init__(self, report):
        self.report, self.history = report, []

    def walk(self, path, make):
        steps = []
        if not path.startswith("expense_report."):
            return None
        for part in path[len("expense_report.") :].split("."):
            if not (m := re.fullmatch(r"([^\[]+)((?:\[[0-9]+\])*)", part)):
                return None
            steps += [m[1], *[int(i) for i in re.findall(r"\[([0-9]+)\]", m[2])]]
        here = self.report
        for k, step in enumerate(steps):
            around = here
            if isinstance(step, int):
                if not isinstance(here, list) or step >= len(here):
                    return None
            elif not isinstance(here, dict):
                return None
            elif step not in here:
                if k < len(steps) - 1 or re.sub(r"\[[0-9]+\]", "[]", path) not in TYPES:
                    return None
                if make:
                    here[step] = {"value": None, "_meta": json.loads(replay.EDIT_META)}
                else:
                    return {"value": None}, "value"
            here = here[step]
        return (here, "value") if isinstance(here, dict) and "value" in here else (around, steps[-1])

    def edit(self, path, text):
        if path is None or not path.startswith("expense_report."):
            return replay.BAD_PREFIX
        if text is None:
            return replay.NO_TEXT
        text = text.strip(" ")
        found = self.walk(path, False)
        if found is None:
            return replay.UNRESOLVED
        old, template = found[0][found[1]], re.sub(r"\[[0-9]+\]", "[]", path)
        kind = "boolean" if isinstance(old, bool) else "number" if isinstance(old, int | float) else "string" if isinstance(old, str) and old else TYPES.get(template)
        value = text or None
        if kind == "boolean" and text:
            value = {"yes": True, "true": True, "1": True, "y": True, "t": True, "no": False, "false": False, "0": False, "n": False, "f": False}.get(text.lower())
            if value is None:
                return replay.NOT_BOOLEAN
        elif kind == "number" and text:
            bare = text.replace("$", "").replace(",", "").strip()
            try:
                value = float(bare) if bare else None
            except ValueError:
                return replay.NOT_NUMBER
        elif isinstance(value, str) and value not in ALLOWED.get(template, [value]):
            return "must be one of"
        self.history = [*self.history, (path, old)][-20:]
        holder, name = self.walk(path, True)
        holder[name] = value
        self.sum_up()
        return "ok"

    def undo(self):
        if not self.history:
            return replay.NO_UNDO
        path, old = self.history.pop()
        found = self.walk(path, True)
        if found is None:
            return replay.STALE_UNDO
        found[0][found[1]] = old
        self.sum_up()
        return "ok"

    def delete_line(self, k):
        lines = self.report.get("transaction_lines", [])
        if not isinstance(lines, list) or k is None or not 0 <= k < len(lines):
            return replay.OUT_OF_RANGE
        lines.pop(k)
        self.sum_up()
        self.history = []
        return "ok"

    def sum_up(self):
        lines = self.report.get("transaction_lines", [])
        common = [x["common"] for x in lines if isinstance(x, dict) and isinstance(x.get("common"), dict)] if isinstance(lines, list) else []
        fields = lambda name: [c[name]["value"] for c in common if isinstance(c.get(name), dict)]
        amounts = [x for x in fields("line_amount_usd") if isinstance(x, int | float) and not isinstance(x, bool)]
        dates = [x for x in fields("date") if isinstance(x, str) and x]
        for name, found, value in (("total_usd", amounts, round(sum(amounts), 2)), ("transaction_date", dates, min(dates, default=None))):
            if found:
                self.report.setdefault("transaction_summary", {}).setdefault(name, {})["value"] = value


def as_leaves(report):
    """path, kind, value and meta of the leaves of a nested report."""
    out = []

    def go(x, path):
        if isinstance(x, dict) and "value" in x and not isinstance(x["value"], dict | list):
            meta = json.dumps(x["_meta"], separators=(",", ":")) if "_meta" in x else ""
            out.append((path, *scalar(x["value"]), meta))
        elif isinstance(x, dict | list) and x:
            for k, y in x.items() if isinstance(x, dict) else enumerate(x):
                go(y, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]")
        elif isinstance(x, dict | list):
            out.append((path, "object" if isinstance(x, dict) else "array", "{}" if isinstance(x, dict) else "[]", None))
        else:
            out.append((path, *scalar(x), None))

    def scalar(x):
        if isinstance(x, bool):
            return "boolean", str(x).lower()
        return ("null", None) if x is None else ("string", x) if isinstance(x, str) else ("number", str(x).removesuffix(".0"))

    go(report, "expense_report")
    return out if out[0][0] != "expense_report" else []


def random_report(r):
    line = lambda: {"common": {k: v for k, v in {"date": wrap(f"2024-0{r.randint(1, 9)}-01"), "line_amount_usd": wrap(r.choice([12.5, 100.25, 7.0])), "expense_type": wrap("car_rental"), "remarks": wrap(r.choice(["", "note"]))}.items() if r.random() < 0.8}, **({"meal_details": {"has_alcohol_on_receipt": wrap(True)}} if r.random() < 0.5 else {})}
    report = {"general_information": {"event_name": wrap("trip"), "category": wrap("relocation"), "student_certification": {"other": wrap(False)}}, "authorized_by": "me", "transaction_lines": [line() for _ in range(r.randint(0, 5))]}
    if r.random() < 0.5:
        report["transaction_summary"] = {"total_usd": wrap(5.0)}
    return report


PATHS = ["transaction_lines[{}].common.line_amount_usd", "transaction_lines[{}].common.date", "transaction_lines[{}].common.expense_type", "transaction_lines[{}].common.remarks", "transaction_lines[{}].common.original_amount", "transaction_lines[{}].meal_details.has_alcohol_on_receipt", "transaction_lines[{}].meal_details.tip_amount", "transaction_lines[{}].common.nonsense", "general_information.event_name", "general_information.category", "general_information.rush_processing", "general_information.student_certification.other", "general_information.business_purpose.who", "authorized_by", "transaction_summary.total_usd", "transaction_summary.status", "transaction_lines[{}].common.date.value", "authorized_by.x", "a..b", "transaction_lines[{}]x"]
TEXTS = ["$1,234.50", "7", "2023-05-05", "car_rental", "taxi", "yes", "No", "maybe", "", "  ", " text ", "relocation", "draft", None, "12d"]


def test_edits_one_by_one_match_a_loop(spark):
    r = random.Random(11)
    reports, actions, want = {k: random_report(r) for k in range(25)}, [], {}
    first = {k: as_leaves(json.loads(json.dumps(x))) for k, x in reports.items()}
    for k, report in reports.items():
        plain = Plain(report)
        # One report has more actions than an Arrow batch has rows.
        for n in range(12_000 if k == 3 else 80):
            kind = r.choices(["edit", "undo", "delete_line", "other"], [70, 25, 3 if k != 3 else 0.01, 2])[0]
            path = r.choice(["", "x."] if r.random() < 0.02 else ["expense_report."]) + r.choice(PATHS).format(r.randint(0, 6))
            path, text, line = (path if r.random() < 0.99 else None, r.choice(TEXTS), r.randint(-1, 5))
            outcome = plain.edit(path, text) if kind == "edit" else plain.undo() if kind == "undo" else plain.delete_line(line) if kind == "delete_line" else "unknown action"
            actions.append((k, n // 3, n, kind, path if kind == "edit" else None, text if kind == "edit" else None, line if kind == "delete_line" else None, "x"))
            want[k, n] = (outcome, len(plain.history), len(report["transaction_lines"]))
    r.shuffle(actions)
    acts = spark.createDataFrame(actions, "report_id long, ts long, event_id long, action string, path string, new_text string, line_idx int, kind string")
    leaves = spark.createDataFrame([(k, *x) for k, xs in first.items() for x in xs], "report_id long, path string, kind string, value string, meta string")
    folded = replay.replay(acts.repartition(5), leaves.repartition(3), catalog.field_types(spark, "{}")).cache()
    got = {(x["report_id"], x["event_id"]): (re.sub("^(must be one of).*", r"\1", x["outcome"]), x["undoable"], x["n_lines"]) for x in replay.log(folded).collect()}
    assert got == want and len({x[0] for x in want.values()}) >= 9
    ends: dict = {k: [] for k in reports}
    for x in replay.leaves_after(folded).collect():
        ends[x["report_id"]].append((x["path"], x["kind"], x["value"], x["meta"]))
    assert {k: sorted(v, key=str) for k, v in ends.items()} == {k: sorted(as_leaves(x), key=str) for k, x in reports.items()}
    assert {x["report_id"]: x["available"] for x in replay.undo_available(folded).collect()}.keys() == reports.keys()


def act(*rows):
    return [(1, k, k, *x) for k, x in enumerate(rows)]


def run(spark, leaves, actions):
    kind = "report_id long, ts long, event_id long, action string, path string, new_text string, line_idx int"
    folded = replay.replay(spark.createDataFrame(actions, kind), spark.createDataFrame(leaves, "report_id long, path string, kind string, value string, meta string"), catalog.field_types(spark)).collect()
    return [r["outcome"] for r in sorted(folded, key=lambda r: r["n"] or 0) if r["what"] == "action"], {r["path"]: (r["kind"], r["value"], r["meta"]) for r in folded if r["what"] == "leaf"}


def test_cases_of_the_rules(spark):
    date, purpose = "expense_report.transaction_lines[0].common.date", "expense_report.general_information.business_purpose.who"
    # A report without lines has no line 99, and a missing parent isn't made.
    assert run(spark, [], act(("edit", "expense_report.transaction_lines[99].common.date", "2024-01-01", None), ("edit", purpose, "me", None))) == ([replay.UNRESOLVED] * 2, {})
    # A missing last name is made with metadata, if the catalogue knows it; undone, it is null.
    start = [(1, date, "string", "2024-01-02", "{}")]
    outcomes, left = run(spark, start, act(("edit", date.replace("date", "original_amount"), "$5", None), ("edit", date.replace("date", "novel"), "x", None), ("undo", None, None, None)))
    assert outcomes == ["ok", replay.UNRESOLVED, "ok"] and left[date.replace("date", "original_amount")] == ("null", None, replay.EDIT_META)
    # A replaced container comes back whole.
    outcomes, left = run(spark, start, act(("edit", "expense_report.transaction_lines[0].common", "gone", None), ("edit", date, "2024-05-05", None), ("undo", None, None, None)))
    assert outcomes == ["ok", replay.UNRESOLVED, "ok"] and left[date] == ("string", "2024-01-02", "{}")
    # The last line leaves an empty list, and nothing can be undone behind it.
    outcomes, left = run(spark, start, act(("edit", date, "2024-05-05", None), ("delete_line", None, None, 0), ("undo", None, None, None), ("delete_line", None, None, 0)))
    assert outcomes == ["ok", "ok", replay.NO_UNDO, replay.OUT_OF_RANGE] and left["expense_report.transaction_lines"] == ("array", "[]", None)
    # No more than twenty edits can be undone.
    assert run(spark, start, act(*[("edit", date, f"2024-01-{k + 1:02}", None) for k in range(25)], *[("undo", None, None, None)] * 22))[0].count(replay.NO_UNDO) == 2
    assert run(spark, start, []) == ([], {date: ("string", "2024-01-02", "{}")}) and run(spark, [], []) == ([], {})


@pytest.mark.parametrize(("path", "steps"), [("a.b[0][12].c", ["a", "b", "0", "12", "c"]), ("a-b.é x[3]", ["a-b", "é x", "3"]), ("a]b", ["a]b"]), ("a..b", None), ("a[x]", None), ("", None), ("[0]", None), ("a.", None), ("a[0]b", None), ("a\nb", ["a\nb"])])
def test_steps_of_paths(spark, path, steps):
    assert spark.createDataFrame([(path,)], "p string").select(S.path_steps(F.col("p"))).first()[0] == steps


def test_ids_end_where_the_text_ends(spark):
    assert [r[0] for r in spark.createDataFrame([("ab",), ("ab\n",), ("a b",)], "p string").select(S.valid_id(F.col("p"))).collect()] == [True, False, False]
