"""Folding of identity values, shared by every operator that compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column) -> Column:
    """Trimmed, each run of whitespace one space, lower case; empty or null gives null."""
    x = F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    x = F.trim(x)
    return F.when(x != "", x)
