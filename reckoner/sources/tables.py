"""Rows of HTML tables, however broken, and the mileage rates in them.

A table is found by its class. Cells and rows end where the next one begins or something
around them ends, with or without end tags; th counts as td; character references are
decoded; tables inside cells are tables of their own. If a table has a tbody, only rows in
one count.

Defined results: a null page has no rows; text outside cells, comments, scripts and styles are passed over;
of a period that comes twice on a page the later row counts; repeated pages give repeated
rows of cells, and one row of rates; no pages give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class _Table:
    def __init__(self, wanted: bool):
        self.wanted, self.has_body, self.in_body = wanted, False, False
        #: (whether it is in a tbody, cells) of each row, and the text of the open cell.
        self.rows: list[tuple[bool, list[str]]] = []
        self.cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1][1].append(" ".join(html.unescape("".join(self.cell)).split()))
            self.cell = None

    def begin_row(self) -> None:
        self.end_cell()
        self.rows.append((self.in_body, []))


def rows_of(page: str, css_class: str) -> list[list[str]]:
    """The cells of each row of a page's tables of a class, in page order."""
    done: list[_Table] = []
    open_: list[_Table] = []
    at = 0
    for m in _PART.finditer(page):
        if open_ and open_[-1].cell is not None:
            open_[-1].cell.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "table" and not m[2]:
            found = _CLASS.search(m[4])
            names = (found[1] or found[2] or found[3] or "") if found else ""
            open_.append(_Table(css_class in names))
            done.append(open_[-1])
        elif not open_:
            continue
        elif tag == "table":
            open_.pop().end_cell()
        elif tag in ("tbody", "thead", "tfoot"):
            open_[-1].end_cell()
            open_[-1].in_body = tag == "tbody" and not m[2]
            open_[-1].has_body |= tag == "tbody"
        elif tag == "tr":
            open_[-1].end_cell() if m[2] else open_[-1].begin_row()
        elif tag in ("td", "th"):
            if not m[2] and not open_[-1].rows:
                open_[-1].begin_row()
            open_[-1].end_cell()
            if not m[2]:
                open_[-1].cell = []
        elif open_[-1].cell is not None:
            open_[-1].cell.append(" ")
    if open_ and open_[-1].cell is not None:
        open_[-1].cell.append(page[at:])
    for t in open_:
        t.end_cell()
    return [cells for t in done if t.wanted for in_body, cells in t.rows if cells and (in_body or not t.has_body)]


def table_rows(pages: DataFrame, css_class: str = "complex-table") -> DataFrame:
    """page_id, pos and cells of every row of the tables of a class."""
    out = T.StructType([pages.schema["page_id"], *T.StructType.fromDDL("pos int, cells array<string>")])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, pos, cells) for i, page in enumerate(batch.column(1).to_pylist()) if page for pos, cells in enumerate(rows_of(page, css_class))]
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.list_(pa.string())).cast(arrow.field(2).type)], schema=arrow)

    return pages.select("page_id", "html").mapInArrow(run, out)


def rates(pages: DataFrame, css_class: str = "complex-table", strict: bool = True) -> DataFrame:
    """page_id, period, business, charity and medical of rows of four cells and more whose numbers are numbers.

    A page without such a row is an error if ``strict``, else left out.
    """
    cell = lambda k: F.regexp_extract(F.get("cells", F.lit(k)), r"^[^0-9.]*([0-9]+(?:\.[0-9]+)?|\.[0-9]+)[^0-9]*$", 1).try_cast("double")
    names = ("business", "charity", "medical")
    parsed = table_rows(pages, css_class).where(F.size("cells") >= 4).select("page_id", "pos", F.get("cells", F.lit(0)).alias("period"), *[cell(k + 1).alias(n) for k, n in enumerate(names)])
    good = parsed.dropna(subset=list(names)).groupBy("page_id", "period").agg(*[F.max_by(n, "pos").alias(n) for n in names])
    if not strict:
        return good
    asked = pages.select(F.col("page_id").alias("_asked")).distinct()
    met = asked.join(good, F.col("_asked").eqNullSafe(F.col("page_id")), "left")
    checked = F.when(F.col("period").isNull(), F.raise_error(F.concat(F.lit("no rates on page "), F.coalesce(F.col("_asked").cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("period"))
    return met.select(F.col("_asked").alias("page_id"), checked.alias("period"), *names)
