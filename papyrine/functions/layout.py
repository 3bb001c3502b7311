"""Text laid out in columns by blanks, as page text of tables is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import collapse

_BLANK = r"[ \t\r\f\x0b]"
_PART = rf"[^ \t\r\f\x0b]+(?:{_BLANK}[^ \t\r\f\x0b]+)*|{_BLANK}+"


def segments(line: Column) -> Column:
    """struct(start, text) of a line's segments, parted by two blanks or more; start counts from 0."""
    parts = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(_PART), F.lit(0))
    placed = F.transform(parts, lambda x, i: F.struct(F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y)).alias("start"), x.alias("text")))
    return F.filter(placed, lambda p: F.trim(p["text"], F.lit(" \t\r\f\x0b")) != "")


def cells_at(line: Column, anchors: Column) -> Column:
    """Cells of a line below column anchors (rising places): each reaches half-way to its neighbours.

    The last reaches the line's end; a cell without text is blank, and no anchors give none.
    """
    n = F.size(anchors)
    left = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.floor((F.get(anchors, i - 1) + F.get(anchors, i)) / 2).cast("int"))
    right = lambda i: F.when(i == n - 1, F.length(line)).otherwise(F.greatest(F.floor((F.get(anchors, i) + F.get(anchors, i + 1)) / 2).cast("int"), F.get(anchors, i) + 1))
    return F.transform(anchors, lambda a, i: collapse(F.substring(line, left(i) + 1, F.greatest(right(i) - left(i), F.lit(0)))))
