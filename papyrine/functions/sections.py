"""Kinds of headings and sections, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import collapse

# ---- fixed values
OPENING_HEADER = "Document Metadata/Abstract"
STRUCTURAL = ("abstract", "introduction", "background", "methods", "materials", "results", "discussion", "conclusion", "summary", "references", "bibliography", "acknowledg", "funding", "conflict", "author contribution", "data availability")
BACK_MATTER = ("references", "bibliograph", "acknowledg", "funding", "conflict", "copyright", "data availability")
FRONT_MATTER = ("funding", "acknowledg", "competing interest", "conflict of interest", "copyright", "author contribution", "data availability")
CITATION_LIKE = r"\b(editorial commentary|commentary by|clinical infectious diseases|doi[:/]|vol(?:ume)?\b|issue\b)\b"
CANONICAL = (
    ("abstract", r"document metadata|structured abstract|abstract|summary"),
    ("introduction", r"introduction|background"),
    ("methods", r"materials|material and methods|method"),
    ("results", r"result"),
    ("discussion", r"discussion"),
    ("conclusion", r"conclusion"),
)
#: Kinds of headings that name no section: kind, pattern (of the lower-case heading where it has
#: a word boundary), most words, whether all letters are capitals. The first that fits counts.
HEADING_KINDS = (
    ("citation_like", CITATION_LIKE, None, False),
    ("subsection", r"^[A-Za-z0-9&/\- ]+$", 4, False),
    ("subsection", None, 8, True),
)
OTHER_KIND = "title_like"
#: Headings that open a section by their words: least words, pattern, whether all capitals.
THEMATIC = ((4, None, True), (5, r"^[A-Za-z0-9&/\-(),:; ]+$", False))
#: What such a heading opens: words in it and the section.
THEMES = (("summary", "Summary"), ("reference", "References"), ("bibliograph", "References"))
#: What follows a section where the heading's words don't say.
FOLLOWING = {OPENING_HEADER: "Introduction", "Introduction": "Discussion", "Discussion": "Conclusion"}
NUMBERING = r"^\d+(?:\s*[.|-]\s*|\.\d+\s*[.|-]\s*)*"


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts is a substring."""
    found = c.contains(parts[0])
    for p in parts[1:]:
        found = found | c.contains(p)
    return found


def _low(header: Column) -> Column:
    return F.lower(F.trim(F.coalesce(header, F.lit(""))))


def is_structural(header: Column) -> Column:
    h = _low(header)
    return ~h.isin("unknown", "") & any_of(h, STRUCTURAL)


def section_role(header: Column) -> Column:
    """unknown, references, front_matter or body."""
    h = _low(header)
    return (
        F.when(h.isin("unknown", ""), "unknown")
        .when(any_of(h, ("reference", "bibliograph")), "references")
        .when(any_of(h, FRONT_MATTER), "front_matter")
        .otherwise("body")
    )


def word_count(header: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(header, F.lit(""))), r"\s+"), lambda w: w != ""))


def header_kind(header: Column) -> Column:
    """Kind of a heading that names no section: opening_metadata, citation_like, subsection, title_like."""
    h = F.trim(F.coalesce(header, F.lit("")))
    out = F.when(h == "", "opening_metadata")
    for kind, pattern, most, capitals in HEADING_KINDS:
        fits = F.lit(True)
        if pattern:
            fits = fits & (F.lower(h) if pattern == CITATION_LIKE else h).rlike(pattern)
        if most:
            fits = fits & (word_count(h) <= most)
        if capitals:
            fits = fits & (F.upper(h) == h) & (F.lower(h) != h)
        out = out.when(fits, kind)
    return out.otherwise(OTHER_KIND)


def heading_kind(text: str) -> str:
    """The same of one heading with text, in a fold over a document."""
    for kind, pattern, most, capitals in HEADING_KINDS:
        shown = text.lower() if pattern == CITATION_LIKE else text
        if (not pattern or re.search(pattern, shown)) and (not most or len(text.split()) <= most) and (not capitals or text.isupper()):
            return kind
    return OTHER_KIND


def opens_section(text: str) -> bool:
    """Whether a heading that isn't the first opens a section by its words alone."""
    low = text.lower()
    if heading_kind(text) == "citation_like" or any(t in low for t in BACK_MATTER):
        return False
    return any(len(text.split()) >= least and (not pattern or re.search(pattern, text)) and (not capitals or text.isupper()) for least, pattern, capitals in THEMATIC)


def next_section(current: str, text: str, deeper: bool) -> str:
    """The section that a thematic heading opens after ``current``; a deeper one stays within it."""
    named = [section for word, section in THEMES if word in text.lower()]
    if named:
        return named[0]
    return current if deeper and current != OPENING_HEADER else FOLLOWING.get(current, current)


def canonical_sections(header: Column) -> Column:
    """Canonical sections a heading names, in fixed order."""
    h = F.regexp_replace(collapse(F.lower(F.coalesce(header, F.lit("")))), NUMBERING, "")
    h = collapse(F.translate(h, "|/", "  "))
    return F.filter(F.array(*[F.when(h.rlike(p), F.lit(s)) for s, p in CANONICAL]), lambda x: x.isNotNull())


def is_non_structural(header: Column) -> Column:
    h = collapse(F.lower(F.coalesce(header, F.lit(""))))
    return (h == "") | ~any_of(h, STRUCTURAL)


def is_metadata_like(header: Column) -> Column:
    return any_of(F.lower(F.coalesce(header, F.lit(""))), ("abstract", "summary", "document metadata"))


def header_matches(header: Column, expected: Column) -> Column:
    """Equal to an expected heading, or sharing a canonical section with one (``expected`` is an array)."""
    h = collapse(F.lower(F.coalesce(header, F.lit(""))))
    own = F.transform(expected, lambda e: collapse(F.lower(e)))
    shared = F.flatten(F.transform(own, canonical_sections))
    return F.array_contains(own, h) | F.arrays_overlap(canonical_sections(header), shared)
