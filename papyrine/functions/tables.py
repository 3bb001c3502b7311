"""What tables hold: semantics, captions, and the trimming of title rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import CAPTION_CHARS, collapse

# ---- fixed values
METRIC_WORDS = r"\b(?:sensitivity|specificity|accuracy|positive predictive|negative predictive|ppv|npv|auc|roc|lod|limit of detection)\b"
QUANTITIES = r"\b\d+(?:\.\d+)?\s*%|\b\d+\.\d+\b|\btrue positive\b|\bfalse positive\b|\bfalse negative\b|\btrue negative\b"
COMPARISON = r"\b(?:control|versus|compared?|comparison|with and without|groups?|arms?)\b"
COUNTS = r"\bno\.\b|\bcount\b|\bn\s*=|\btotal\b"
WINDOW_ROWS, SPARSE, LOW_VARIANCE, TEXT_SHARE = 10, 0.7, 0.35, 0.5


def semantics(text: Column) -> Column:
    """Which of metric, comparison and count a table's lower-case text shows, in that order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(
        F.array(F.when(t.rlike(METRIC_WORDS) & t.rlike(QUANTITIES), F.lit("metric")), F.when(t.rlike(COMPARISON), F.lit("comparison")), F.when(t.rlike(COUNTS), F.lit("count"))),
        lambda x: x.isNotNull(),
    )


def caption(title_rows: Column, payload: Column) -> Column:
    """First title row with text, else the payload's first line with text, cut to length."""
    titles = F.filter(F.transform(title_rows, lambda r: F.array_join(F.filter(F.transform(r, lambda x: F.trim(x)), lambda x: x != ""), " ")), lambda x: x != "")
    lines = F.filter(F.transform(F.split(payload, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(F.coalesce(F.get(titles, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), F.lit(CAPTION_CHARS))


def header_row(rows: Column) -> Column:
    """Place of the header among a matrix's first rows, or null where none is sure.

    ``rows`` is array<array<string>> with nulls for absent cells. Rows far sparser than
    the usual row, or repeating one value, are titles; the header is the first row as
    dense as usual with half its cells holding letters.
    """
    top = F.slice(rows, 1, WINDOW_ROWS)
    density = F.transform(top, lambda r: F.size(F.filter(r, lambda x: x.isNotNull())))
    dense = F.filter(density, lambda n: n > 1)
    source = F.when(F.size(dense) > 0, dense).otherwise(density)
    counted = F.transform(F.array_distinct(source), lambda n: F.struct((-F.size(F.filter(source, lambda m: m == n))).alias("times"), n.alias("n")))
    mode = F.get(F.array_sort(counted), F.lit(0))["n"]
    sparse = F.greatest(F.lit(1), F.floor(mode * SPARSE))

    def sure(r: Column) -> Column:
        n = F.size(F.filter(r, lambda x: x.isNotNull()))
        v = F.filter(F.transform(F.filter(r, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))), lambda x: x != "")
        title = ((n <= sparse) & (n < mode)) | ((F.size(v) > 0) & (F.size(F.array_distinct(v)) / F.greatest(F.size(v), F.lit(1)) <= LOW_VARIANCE))
        letters = F.size(F.filter(v, lambda x: x.rlike(r"\p{L}"))) / F.greatest(F.size(v), F.lit(1))
        return ~title & (n >= mode) & (letters >= TEXT_SHARE)

    place = F.get(F.filter(F.transform(top, lambda r, i: F.when(sure(r), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(mode > 1, place)


def trim_titles(rows: Column) -> Column:
    """struct(trimmed, titles, rows): title rows above the header taken off; nothing where no header is sure."""
    at = F.coalesce(header_row(rows), F.lit(0))
    return F.struct(
        at.alias("trimmed"),
        F.transform(F.slice(rows, F.lit(1), at), lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit("")))).alias("titles"),
        F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0))).alias("rows"),
    )


def csv_cells(text: Column) -> Column:
    """Rows of cells of a CSV text; separators and line feeds within quotes part nothing.

    Quotes alternate between outside and inside, so what lies at odd places of the text cut
    at its quotes is outside.
    """
    parts = F.transform(F.split(text, '"'), lambda x, i: F.when(i % 2 == 0, F.translate(x, ",\n", "\x01\x02")).otherwise(x))

    def cell(c: Column) -> Column:
        t = F.trim(c)
        quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
        return F.when(quoted, F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(c)

    return F.transform(F.split(F.array_join(parts, '"'), "\x02"), lambda r: F.transform(F.split(r, "\x01"), cell))


def has_content(table: Column) -> Column:
    """Whether any cell of a parsed table's rows says something."""
    rows = F.coalesce(table["rows"], F.array())
    return F.exists(rows, lambda r: F.exists(F.map_values(r), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))


def has_repeats(texts: Column) -> Column:
    """Whether two of a document's tables are the same, but for case and blanks; blank ones don't count."""
    known = F.filter(F.transform(texts, lambda x: collapse(F.lower(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    return F.size(known) > F.size(F.array_distinct(known))


def origin(parsed: Column, markdown: Column, repeated: Column) -> Column:
    """parser or markdown: whose tables count, from both numbers and whether the parser's repeat."""
    return F.when((parsed == 0) | (markdown > parsed) | ((markdown > 0) & repeated), "markdown").otherwise("parser")
