"""Catalogue tables of a schema file."""

from __future__ import annotations

import json

from reckoner.sources import schema

FILE = {
    "schema_version": "0.1",
    "expense_report": {
        "general": {
            "category": {"type": "enum", "required": True, "source": "T3", "allowed_values": ["b", "a", "c"], "infer_from": "docs"},
            "payee": {"type": "object", "required": True, "source": "T1", "fields": {"name": {"type": "string", "required": True}, "age": {"type": "number", "source": "T2", "required": False}}},
        },
        "lines": {
            "type": "array", "source": "T4", "items": {"type": "object", "fields": {
                "amount": {"type": "number", "required": "category == a", "depends_on": ["expense_report.general.category"]},
                "tags": {"type": "array", "items": {"type": "string", "source": "T2"}},
                "inner": {"x": {"type": "boolean"}},
            }},
        },
    },
}


def test_nodes_tiers_and_rules(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(FILE))
    nodes = schema.read_schema(spark, str(tmp_path / "schema.json"))
    got = {r["template"][len("expense_report.") :]: r for r in nodes.collect()}
    want = {
        "general.category": ("enum", True, None, ["b", "a", "c"], "T3", "select", "model_prefill_review", "medium"),
        "general.payee": ("object", True, None, None, "T1", "text", "user_confirmed_input", "high"),
        "general.payee.name": ("string", True, None, None, "T1", "text", "user_confirmed_input", "high"),
        "general.payee.age": ("number", False, None, None, "T2", "number", "computed_readonly", "low"),
        "lines": ("array", False, None, None, "T4", "text", "model_prefill_review", "low"),
        "lines[]": ("object", False, None, None, "T4", "text", "model_prefill_review", "low"),
        "lines[].amount": ("number", False, "category == a", None, "T4", "currency", "model_prefill_review", "high"),
        "lines[].tags": ("array", False, None, None, "T4", "text", "model_prefill_review", "low"),
        "lines[].tags[]": ("string", False, None, None, "T2", "text", "computed_readonly", "low"),
        "lines[].inner.x": ("boolean", False, None, None, "T4", "checkbox", "model_prefill_review", "low"),
    }
    assert {k: (r["type"], r["required"], r["required_expression"], r["allowed"], r["tier"], r["control"], r["entry_mode"], r["priority"]) for k, r in got.items()} == want
    assert got["lines[].amount"]["depends_on"] == ["expense_report.general.category"] and got["general.category"]["infer_from"] == "docs"
    types = {r["template"]: (r["type"], r["allowed"]) for r in schema.field_types(nodes).collect()}
    assert len(types) == 6 and types["expense_report.general.category"] == ("enum", ["b", "a", "c"])
    assert schema.rules(nodes).count() == 10
    (tmp_path / "none.json").write_text('{"expense_report": {}}')
    assert schema.read_schema(spark, str(tmp_path / "none.json")).count() == 0
