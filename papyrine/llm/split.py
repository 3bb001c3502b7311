"""Splitting oversized items at natural boundaries into balanced, overlapping pieces.

The coarsest kind of boundary that leaves only parts within the limit is found first:
paragraph, line, sentence, else hard. Then the least number of pieces is computed, equal
length targets are placed, and each is snapped to the strongest boundary near it; when a
piece fails the limit the number of pieces grows by one. Where parts are so uneven that a
boundary must be far from its target, targets can't be fixed beforehand: then the cuts of
the fewest pieces, and among these of the least spread of lengths, are found over all
boundaries, which always exist. Only oversized items reach
Python, and each is cut whole, by itself; no item depends on another, so there is no
shuffle after the current rows are chosen.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n"
OVERLAP = 120
#: Limits of the two kinds of items, in code points.
CHUNK_LIMIT, DOCUMENT_LIMIT = 900, 6000
_PARAGRAPH = re.compile(r"\n(?:[ \t\r]*\n)+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r]+(?=[A-Z0-9])")
_WORD = re.compile(r"[ \t\r\n]+")
LEVELS = ("paragraph", "line", "sentence", "hard")
PARAGRAPH, LINE, SENTENCE, WORD, ANY = 4, 3, 2, 1, 0


def trimmed_length(c: Column) -> Column:
    """Code points after trimming spaces, tabs, CR and LF."""
    return F.length(F.trim(c, F.lit(BLANKS)))


def boundaries(text: str) -> dict[int, int]:
    """Places where a piece may begin, each with its strength."""
    found: dict[int, int] = {}
    for m in _WORD.finditer(text):
        found[m.end()] = WORD
    for m in _SENTENCE.finditer(text):
        found[m.end()] = SENTENCE
    at = text.find("\n")
    while at >= 0:
        found[at + 1] = LINE
        at = text.find("\n", at + 1)
    for m in _PARAGRAPH.finditer(text):
        for k in range(m.start() + 1, m.end()):
            found.pop(k, None)
        found[m.end()] = PARAGRAPH
    found.pop(0, None)
    found.pop(len(text), None)
    return found


def _span(text: str, a: int, b: int) -> int:
    return len(text[a:b].strip(BLANKS))


def _parts_fit(text: str, cuts: list[int], limit: int) -> bool:
    edges = [0, *cuts, len(text)]
    return all(b - a <= limit or _span(text, a, b) <= limit for a, b in zip(edges, edges[1:]))


def cut_level(text: str, limit: int, found: dict[int, int]) -> str:
    """The coarsest kind of boundary at which all parts are within the limit."""
    for name, least in zip(LEVELS, (PARAGRAPH, LINE, SENTENCE)):
        if _parts_fit(text, sorted(k for k, s in found.items() if s >= least), limit):
            return name
    return "hard"


def _fewest(text: str, allowed: list[int], limit: int) -> list[int]:
    """Cuts at allowed places for the fewest pieces within the limit, of least spread among those.

    Every stretch between neighbouring places is within the limit. Lengths are measured
    without blanks at the ends, as limits are.
    """
    places = [0, *allowed, len(text)]
    # First character that is no blank at or after a place, and the end of the last before it.
    lead = [p + len(text[p:q]) - len(text[p:q].lstrip(BLANKS)) for p, q in zip(places, places[1:])] + [len(text)]
    trail = [0] + [q - (len(text[p:q]) - len(text[p:q].rstrip(BLANKS))) for p, q in zip(places, places[1:])]
    for k in range(len(places) - 2, -1, -1):
        if lead[k] >= places[k + 1]:
            lead[k] = lead[k + 1]
    for k in range(1, len(places)):
        if trail[k] <= places[k - 1]:
            trail[k] = trail[k - 1]
    n = len(places)
    count = [0] + [n] * (n - 1)
    first = [0] * n
    low = 0
    for j in range(1, n):
        while trail[j] - lead[low] > limit:
            low += 1
        # Counts never fall along the places, so the furthest start gives the fewest pieces.
        count[j], first[j] = count[low] + 1, low
    target = (trail[-1] - lead[0]) / count[-1]
    best = [0.0] + [float("inf")] * (n - 1)
    back = [0] * n
    for j in range(1, n):
        i = first[j]
        while i < j and count[i] == count[j] - 1:
            cost = best[i] + (max(0, trail[j] - lead[i]) - target) ** 2
            if cost < best[j]:
                best[j], back[j] = cost, i
            i += 1
    cuts, j = [], back[n - 1]
    while j > 0:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def _with_hard_places(text: str, allowed: list[int], limit: int) -> list[int]:
    """Allowed places and, in stretches beyond the limit, even ones that part them."""
    out: list[int] = []
    for a, b in zip([0, *allowed], [*allowed, len(text)]):
        if _span(text, a, b) > limit:
            start, end = a + len(text[a:b]) - len(text[a:b].lstrip(BLANKS)), a + len(text[a:b].rstrip(BLANKS))
            parts = -(-(end - start) // limit)
            out += [start + (end - start) * k // parts for k in range(1, parts)]
        if b < len(text):
            out.append(b)
    return out


def balanced_cuts(text: str, limit: int, level: str, found: dict[int, int]) -> list[int]:
    """Cuts for pieces within the limit, near equal lengths, at the strongest boundaries."""
    least = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "hard": WORD}[level]
    allowed = sorted(k for k, s in found.items() if s >= least)
    if level == "hard":
        allowed = _with_hard_places(text, allowed, limit)
    total = len(text)
    n = max(2, -(-_span(text, 0, total) // limit))
    cuts = _snapped(text, allowed, limit, n, found)
    if cuts is None:
        fewest = _fewest(text, allowed, limit)
        # Pieces are added up to the number that the boundaries make necessary.
        cuts = _snapped(text, allowed, limit, len(fewest) + 1, found) if len(fewest) + 1 > n else None
        cuts = fewest if cuts is None else cuts
    return cuts


def _snapped(text: str, allowed: list[int], limit: int, count: int, found: dict[int, int]) -> list[int] | None:
    """Equal-length targets for ``count`` pieces, each snapped to the strongest boundary near it; None where a piece fails."""
    total = len(text)
    size = total / count
    near = max(limit - size, size / 4)
    cuts: list[int] = []
    for i in range(1, count):
        target = i * size
        low = bisect.bisect_left(allowed, max(target - near, (cuts[-1] if cuts else 0) + 1))
        high = bisect.bisect_right(allowed, target + near)
        best = min(allowed[low:high], key=lambda p: (-found.get(p, ANY), abs(p - target)), default=None)
        if best is None:
            return None
        cuts.append(best)
    return cuts if _parts_fit(text, cuts, limit) else None


def overlap_start(text: str, before: int, cut: int, room: int, found: list[int]) -> int:
    """Where the repeated text begins that a piece shares with the one before it."""
    low = max(before, cut - room)
    k = bisect.bisect_left(found, low)
    return found[k] if k < len(found) and found[k] < cut else cut


def split_text(text: str, limit: int, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The kind of cut and (begin, core, end) of each piece in ``text``.

    text[core:end] of all pieces are the whole text in order; text[begin:core] repeats
    the end of the piece before, at most ``overlap`` code points beginning at a boundary,
    and less where the limit leaves less room.
    """
    found = boundaries(text)
    level = cut_level(text, limit, found)
    # Leaving room for the overlap where the parts allow it.
    inner = limit - overlap
    own = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "hard": ANY}[level]
    if level != "hard" and not _parts_fit(text, sorted(k for k, s in found.items() if s >= own), inner):
        inner = limit
    cuts = balanced_cuts(text, inner, level, found)
    places = sorted(found)
    edges, out = [0, *cuts, len(text)], []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        begin = a
        if i and overlap:
            room = min(overlap, limit - _span(text, a, b))
            begin = overlap_start(text, edges[i - 1], a, room, places) if room > 0 else a
            if _span(text, begin, b) > limit:
                begin = a
        out.append((begin, a, b))
    return level, out


def pieces(items: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items longer than their limit.

    ``items`` has item_kind, item_id, content and limit, one row an item. Columns out:
    item_kind, item_id, cut, piece_no (from 1), begin, core, end (offsets in code points
    into content) and piece = content[begin:end]. Items within the limit, null and empty
    ones don't come out; a null item_id stays null; blanks at the ends belong to the first
    and last piece, so that the cores make up the content exactly.
    """
    big = items.where(trimmed_length(F.col("content")) > F.col("limit")).select("item_kind", "item_id", "content", "limit")
    schema = T.StructType(
        [T.StructField(n, k) for n, k in (("item_kind", T.StringType()), ("item_id", T.StringType()), ("cut", T.StringType()), ("piece_no", T.IntegerType()), ("begin", T.IntegerType()), ("core", T.IntegerType()), ("end", T.IntegerType()), ("piece", T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("item_kind", pa.string()), ("item_id", pa.string()), ("cut", pa.string()), ("piece_no", pa.int32()), ("begin", pa.int32()), ("core", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])
        for batch in batches:
            rows: list[tuple] = []
            for kind, item, text, limit in zip(*(c.to_pylist() for c in batch.columns)):
                level, cuts = split_text(text, limit, overlap)
                rows += [(kind, item, level, i + 1, a, c, b, text[a:b]) for i, (a, c, b) in enumerate(cuts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return big.mapInArrow(run, schema)


def current_items(df: DataFrame, kind: str, id_col: str, text_col: str, at: str, limit: int) -> DataFrame:
    """The current row of each id (the latest ``at``), with content only where it is oversized.

    Contents within the limit are dropped before the shuffle, so only the ids and lengths
    of most rows move. Among rows of the same time the longest, then the largest content
    counts; null times come last.
    """
    n = F.coalesce(trimmed_length(F.col(text_col)), F.lit(0))
    row = F.struct(F.col(at).alias("t"), n.alias("n"), F.when(n > limit, F.col(text_col)).alias("content"))
    latest = df.select(F.col(id_col).cast("string").alias("item_id"), row.alias("r")).groupBy("item_id").agg(F.max("r").alias("r"))
    return latest.where(F.col("r.n") > limit).select(F.lit(kind).alias("item_kind"), "item_id", F.col("r.content").alias("content"), F.lit(limit).alias("limit"))


def oversized(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Oversized current chunks and parsed documents."""
    a = current_items(chunks, "chunk", "id", "content", "ingested_at", CHUNK_LIMIT)
    b = current_items(documents, "document", "doc_id", "markdown_text", "parsed_at", DOCUMENT_LIMIT)
    return a.unionByName(b)
