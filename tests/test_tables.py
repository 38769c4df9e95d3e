"""Broken tables, merges, retries, test users, and the first rows of groups."""

from __future__ import annotations

import pytest

from reckoner.operators import jobs, quality, reduce, store
from reckoner.sources import tables

PAGE = """<table class=other><tbody><tr><td>2020<td>1<td>2<td>3</table>
<table id=x class="wide complex-table cols"><thead><tr><th>Period<th>Business<th>Charity<th>Medical</thead>
<tbody><tr><th scope=row>2024 &amp; on<td>67&nbsp;&cent;<td>14<td>21<td><a href="x>y">IRS</a>
<tr><td>2023</td><td>65.5</td><td>14</td><td><table class="note"><tr><td>inner<td>1<td>2<td>3</table>22</td></tr>
<!-- <tr><td>1999<td>1<td>1<td>1 --><tr><td>footnote<td>see below<td>14<td>22<tr><td>short<td>1
<tr><td>2023<td>66<td>14<td>.5<script>"<tr><td>1998<td>1<td>1<td>1"</script></tbody><tfoot><tr><td>9<td>9<td>9<td>9</table>"""


def test_rates_of_broken_tables(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, "<table class='complex-table'><tr><td>a<td>1<td>2<td>3", "x")], "page_id long, html string, cells string")
    got = sorted(tuple(r) for r in tables.rates(pages).collect())
    assert got == [(1, "2023", 66.0, 14.0, 0.5), (1, "2024 & on", 67.0, 14.0, 21.0), (2, "a", 1.0, 2.0, 3.0)]
    none = spark.createDataFrame([(3, "<table class=complex-table><tr><td>x<td>y<td>z<td>w</table>"), (4, None), (5, "")], "page_id long, html string")
    assert tables.rates(none, strict=False).count() == 0 and tables.rates(none.limit(0)).count() == 0
    with pytest.raises(Exception, match="no rates on page"):
        tables.rates(none).collect()


def test_a_key_that_is_there_wins_even_if_null(spark):
    main = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "document_id long, x string, y string")
    extra = spark.createDataFrame([(1, None, None, ["x"]), (2, "c", None, ["x", "z"])], "document_id long, x string, y string, keys array<string>")
    got = {r["document_id"]: (r["x"], r["y"]) for r in reduce.merge_extractions(main, extra, present="keys").collect()}
    assert got == {1: (None, "b"), 2: ("c", "b")}
    assert {r["document_id"]: (r["x"], r["y"]) for r in reduce.merge_extractions(main, extra.drop("keys")).collect()} == {1: ("a", "b"), 2: ("c", "b")}


def test_lost_connections_are_retried_and_test_users_known(spark):
    names = {"ConnectionResetError": True, "BrokenPipeError": True, "TimeoutError": True, "JSONDecodeError": False, None: False}
    df = spark.createDataFrame([(n, None) for n in names], "n string, c int")
    assert [r[0] for r in df.select(jobs.is_retryable(df.c, df.n)).collect()] == list(names.values())
    users = {"fmtest": True, "e2etest": True, "scope_0af": True, "hist12": True, "pipelinetest7": True, "testing": False, "scope_x": False, "xfmtest": False, None: False}
    df = spark.createDataFrame([("up", u) for u in users], "i string, u string")
    assert [r[0] for r in df.select(store.is_test_report(df.i, df.u)).collect()] == list(users.values())


def test_first_rows_and_the_number_of_the_rest(spark):
    rows = spark.createDataFrame([("a", k) for k in range(30)] + [("b", 1), (None, 5), (None, 4), (None, 3)], "g string, x long")
    got = sorted((str(r["g"]), r["x"], r["place"], r["rest"]) for r in quality.first_of_each(rows, ["g"], ["x"], 2).collect())
    assert got == [("None", 3, 1, 1), ("None", 4, 2, 1), ("a", 0, 1, 28), ("a", 1, 2, 28), ("b", 1, 1, 0)]
