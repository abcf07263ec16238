"""Nested tables as arrays of rows of cells: header shape, labels, and two ways to say a table in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(lo, hi) -> Column:
    """lo .. hi - 1; empty where hi <= lo (sequence would count down)."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return F.when(hi > lo, F.sequence(lo, F.greatest(hi - 1, lo))).otherwise(F.array().cast("array<int>"))


def cell(rows: Column, i, j) -> Column:
    i, j = (F.lit(x) if isinstance(x, int) else x for x in (i, j))
    return F.coalesce(F.trim(F.get(F.get(rows, i), j)), F.lit(""))


def width(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))


def expand_merged(spans: Column) -> Column:
    """Cells (text, span): a merged cell is its text and then blanks."""
    return F.flatten(F.transform(spans, lambda c: F.concat(F.array(c["text"]), F.array_repeat(F.lit(""), F.greatest(c["span"] - 1, F.lit(0))))))


def header_depth(rows: Column) -> Column:
    """2 where the first row has a merged cell whose gap the second fills and the second names two columns; else 1."""
    w0, w1 = F.size(F.get(rows, F.lit(0))), F.size(F.get(rows, F.lit(1)))
    spans = F.exists(_range(0, w0 - 1), lambda j: (cell(rows, 0, j) != "") & (cell(rows, 0, j + 1) == ""))
    fills = F.exists(_range(0, F.least(w0, w1)), lambda j: (cell(rows, 0, j) == "") & (cell(rows, 1, j) != ""))
    named = F.size(F.filter(_range(1, w1), lambda j: cell(rows, 1, j) != ""))
    return F.when((F.size(rows) >= 2) & spans & fills & (named >= 2), 2).otherwise(1)


def data_columns(rows: Column, depth: Column) -> Column:
    """Columns that the last header row names; the first is always a label."""
    return F.filter(_range(1, width(rows)), lambda j: cell(rows, depth - 1, j) != "")


def label_columns(rows: Column, data: Column) -> Column:
    return F.array_except(_range(0, width(rows)), data)


def carried(rows: Column, i, j: Column) -> Column:
    """The cell, or where it is blank the nearest one to its left that isn't."""
    left = F.filter(F.transform(_range(0, j + 1), lambda k: cell(rows, i, k)), lambda v: v != "")
    return F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))


def banner_rows(rows: Column, depth: Column, data: Column) -> Column:
    """1 where the upper header row says the same of every data column, so that it is a title; else 0."""
    same = F.size(F.array_distinct(F.transform(data, lambda j: carried(rows, 0, j)))) == 1
    return F.when((depth == 2) & same, 1).otherwise(0)


def _said(parts: Column, sep: str) -> Column:
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), sep)


def column_label(rows: Column, depth: Column, banner: Column, j: Column) -> Column:
    return _said(F.transform(_range(banner, depth), lambda i: carried(rows, i, j)), " — ")


def row_label(rows: Column, i: Column, labels: Column) -> Column:
    return _said(F.transform(labels, lambda j: cell(rows, i, j)), " — ")


def serial_rows(rows: Column, caption: Column | None = None) -> Column:
    """A line a row: header: value, joined by dashes; blank cells and blank rows are left out."""
    head = F.get(rows, F.lit(0))

    def line(r: Column) -> Column:
        cells = F.filter(F.zip_with(head, F.slice(r, 1, F.greatest(F.size(head), F.lit(1))), lambda h, v: F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.when(F.trim(h) != "", F.concat_ws(": ", F.trim(h), F.trim(v))).otherwise(F.trim(v)))), lambda x: x.isNotNull())
        return F.when(F.size(cells) > 0, F.concat(F.array_join(cells, " — "), F.lit(" ।")))

    body = F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line), lambda x: x.isNotNull())
    return F.array_join(body if caption is None else F.concat(F.filter(F.array(caption), lambda c: c != ""), body), "\n")


def serial_columns(rows: Column, only: Column | None = None) -> Column:
    """A line a data column: its name, then each row's label and value; titles and rows of labels alone come first."""
    depth = header_depth(rows)
    data = data_columns(rows, depth)
    labels, banner = label_columns(rows, data), banner_rows(rows, depth, data)
    used = data if only is None else F.array_intersect(data, only)
    body = _range(depth, F.size(rows))
    title = F.when(banner == 1, F.array(F.concat(carried(rows, 0, F.get(data, F.lit(0))), F.lit(" ।")))).otherwise(F.array().cast("array<string>"))
    alone = F.transform(F.filter(body, lambda i: ~F.exists(used, lambda j: cell(rows, i, j) != "") & (row_label(rows, i, labels) != "")), lambda i: F.concat(row_label(rows, i, labels), F.lit(" ।")))

    def line(j: Column) -> Column:
        bits = F.array_distinct(F.transform(F.filter(body, lambda i: cell(rows, i, j) != ""), lambda i: F.when(row_label(rows, i, labels) != "", F.concat_ws(": ", row_label(rows, i, labels), cell(rows, i, j))).otherwise(cell(rows, i, j))))
        name = column_label(rows, depth, banner, j)
        return F.when(F.size(bits) > 0, F.concat(F.when(name != "", F.concat(name, F.lit(" — "))).otherwise(""), F.array_join(bits, "; "), F.lit(" ।")))

    lines = F.filter(F.transform(used, line), lambda x: x.isNotNull())
    return F.array_join(F.concat(title, alone, lines), "\n")


def markdown_cells(text: Column) -> Column:
    """Cells of the table lines of a markdown text in reading order, without separator rows."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike("^[|:\\- ]+$"))
    cells = F.flatten(F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), "^\\||\\|$", ""), "\\|"), lambda c: F.trim(c))))
    return F.filter(cells, lambda c: c != "")
