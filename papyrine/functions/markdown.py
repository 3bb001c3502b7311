"""Markdown structure as column expressions: blocks, headings, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import strip

DIVIDER = r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?$"
HEADING = r"^(#{1,6})\s+(.*)$"


def blocks(md: Column) -> Column:
    """Blocks parted by blank lines."""
    return F.split(strip(F.coalesce(md, F.lit(""))), r"\n\s*\n")


def first_line(block: Column) -> Column:
    return F.trim(F.get(F.split(block, "\n"), F.lit(0)))


def heading_level(block: Column) -> Column:
    """1 to 6 where the block's first line is a heading, else 0."""
    return F.length(F.regexp_extract(first_line(block), HEADING, 1))


def heading_text(block: Column) -> Column:
    return F.trim(F.regexp_extract(first_line(block), HEADING, 2))


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def is_table_block(block: Column) -> Column:
    """At least two lines, all with two pipes, the second a divider."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: pipes(x) >= 2) & F.coalesce(F.get(lines, F.lit(1)).rlike(DIVIDER), F.lit(False))


def split_row(line: Column) -> Column:
    """Cells of a pipe row, without outer pipes; escaped pipes part cells too."""
    inner = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def table_runs(md: Column) -> Column:
    """Pipe tables anywhere in the text, as arrays of lines.

    A table is a run of consecutive lines with two pipes or more whose second line is a
    divider. Lines outside runs become blank, so runs part at blank blocks.
    """
    lines = F.transform(F.split(F.coalesce(md, F.lit("")), "\n"), lambda x: F.when(pipes(x) >= 2, F.trim(x)).otherwise(""))
    runs = F.transform(F.split(F.array_join(lines, "\n"), r"\n{2,}"), lambda b: F.filter(F.split(b, "\n"), lambda x: x != ""))
    return F.filter(runs, lambda r: (F.size(r) >= 2) & F.coalesce(F.get(r, F.lit(1)).rlike(DIVIDER), F.lit(False)))


def table_headers(run: Column) -> Column:
    return split_row(F.get(run, F.lit(0)))


def table_rows(run: Column) -> Column:
    """Data rows, padded with blanks or cut to the width of the header."""
    width = F.size(table_headers(run))
    return F.transform(F.slice(run, 3, F.greatest(F.size(run) - 2, F.lit(0))), lambda x: F.slice(F.concat(split_row(x), F.array_repeat(F.lit(""), width)), F.lit(1), width))


def unique_headers(headers: Column) -> Column:
    """Blank headers named by place; the k-th repetition gets its number in brackets."""
    named = F.transform(headers, lambda h, i: F.when(h == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h))
    return F.transform(named, lambda h, i: F.when(F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == h)) > 1, F.concat(h, F.lit(" ("), F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == h)).cast("string"), F.lit(")"))).otherwise(h))


def quoted_csv(headers: Column, rows: Column) -> Column:
    """CSV text of a table, cells quoted where they must be."""
    cell = lambda x: F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = lambda r: F.array_join(F.transform(r, cell), ",")
    return F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\n")
