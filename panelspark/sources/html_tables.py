"""Tables of HTML pages as rows of cells, with row and column spans filled in.

Defined cases: a page without a table, a null or an empty one has no row; tables within tables are tables of their own, numbered
by where they begin, and their text isn't that of the cell around them; a missing end tag ends with the next cell, row or table;
white space of a text is one space; a span that isn't a number counts as 1, a row span of 0 goes on to the table's last row; rows that
repeat are read each. Column spans are at most 1,000, as browsers have it; row spans end with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COLUMNS_SPANNED = 1_000
_SILENT = ("script", "style", "template")


@dataclass
class _Cell:
    header: bool
    rows: int | None  # None: to the last row
    columns: int
    text: list[str] = field(default_factory=list)


@dataclass
class _Table:
    number: int
    parent: int | None
    rows: list[list[_Cell]] = field(default_factory=list)
    cell: _Cell | None = None


class _Reader(HTMLParser):
    """Collects the cells of a page's tables, innermost open table last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.tables: list[_Table] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            table = _Table(len(self.tables), self.open[-1].number if self.open else None)
            self.tables.append(table)
            self.open.append(table)
        elif self.open and tag == "tr":
            self.open[-1].cell = None
            self.open[-1].rows.append([])
        elif self.open and tag in ("td", "th"):
            table, given = self.open[-1], dict(attrs)
            if not table.rows:
                table.rows.append([])
            span = lambda name: int(v) if (v := (given.get(name) or "").strip()).isdecimal() else 1
            rows = span("rowspan")
            table.cell = _Cell(tag == "th", rows or None, min(max(span("colspan"), 1), MOST_COLUMNS_SPANNED))
            table.rows[-1].append(table.cell)
        elif self.open and self.open[-1].cell and tag in ("br", "p", "div", "li"):
            self.open[-1].cell.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1].cell = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell and not self.silent:
            self.open[-1].cell.text.append(data)


def cells(html: str) -> Iterator[tuple[int, int | None, int, int, str, bool]]:
    """table, parent table, row, column, text and whether it is a header, of each place of each table's grid."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    for table in reader.tables:
        held: dict[int, tuple[int, _Cell]] = {}  # by column: rows that a cell from above still covers
        for number, row in enumerate(table.rows):
            line: dict[int, _Cell] = {}
            for column, (left, cell) in list(held.items()):
                line[column] = cell
                if left == 1:
                    del held[column]
                else:
                    held[column] = (left - 1, cell)
            at = 0
            for cell in row:
                while at in line:
                    at += 1
                below = (cell.rows or len(table.rows) - number) - 1
                for column in range(at, at + cell.columns):
                    if column in line:
                        break  # a span ends where a cell from above stands
                    line[column] = cell
                    if below > 0:
                        held[column] = (below, cell)
            for column in sorted(line):
                yield table.number, table.parent, number, column, " ".join("".join(line[column].text).split()), line[column].header


def scan(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table, parent, row, column, text and header of every cell of every table of every page."""
    kind = dict(pages.dtypes)[key]
    names = ["table", "parent", "row", "column", "text", "header"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(cells(batch[html][at].as_py()))
                if found:
                    keys = batch[key].take(pa.array([at] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=[key, *names])

    rows = pages.filter(F.contains(F.lower(html), F.lit("<table"))).select(key, html)
    return rows.mapInArrow(run, f"`{key}` {kind}, table int, parent int, row int, column int, text string, header boolean")
