"""Tables found in documents: headers and renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_numeric(cell: Column) -> Column:
    """Whether a cell is a number once ``, % $`` are removed."""
    return cell.rlike(r"\d") & F.regexp_replace(cell, "[,%$]", "").try_cast("double").isNotNull()


def is_header(cells: Column) -> Column:
    """Whether a row is a header: half its cells filled, at most half of these numbers."""
    filled = F.filter(cells, lambda x: F.trim(x) != "")
    numbers = F.filter(filled, is_numeric)
    return (F.size(filled) >= 0.5 * F.size(cells)) & (F.size(numbers) <= 0.5 * F.size(filled))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(headers: Column, rows: Column) -> Column:
    """A table as Markdown lines."""
    rule = _line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(_line(headers), rule), F.transform(rows, _line)), "\n")


def records(headers: Column, rows: Column) -> Column:
    """A table as maps from header to cell; missing cells are empty."""
    def one(row: Column) -> Column:
        return F.map_from_arrays(headers, F.transform(headers, lambda _, i: F.coalesce(F.try_element_at(row, i + 1), F.lit(""))))

    return F.transform(rows, one)
