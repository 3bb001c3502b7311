"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

The merge loop keeps a segment tree over the ranks of adjacent pairs. Its root holds the
lowest rank and, among equals, the leftmost position; a merge touches three leaves, each
updated in logarithmic time, and the loop ends when the root holds no mergeable pair. A
piece of n bytes so costs O(n log n), also for the runs of many thousand letters that
sequences and encoded data bring, where rescanning all pairs after each merge is
quadratic.

Texts are split into pieces by the vocabulary's public pattern. Pieces recur, so each
Python worker keeps the ids of pieces it has met in a table of bounded size; the table is
emptied when full, and pieces longer than ``CACHED_CHARS`` never enter it, so memory does
not grow with the data. The tables are a matter of speed only; ids never depend on them.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("PAPYRINE_TOKENIZERS", "/opt/tokenizers")
#: Public splitting pattern of the byte-level vocabularies, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only, for the faster standard engine.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CACHED_PIECES, CACHED_CHARS = 400_000, 48
NONE = 1 << 30


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by a segment tree over the ranks of adjacent pairs."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    # A node is rank * span + position: one comparison gives lowest rank, then leftmost.
    span = width
    absent = NONE * span
    tree = [absent] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * span + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] < absent:
        i = tree[1] % span
        j = following[i]
        joined = parts[i] + parts[j]
        parts[i], parts[j] = joined, None
        after = following[i] = following[j]
        if j < n - 1:
            put(j, absent)
        if after < n:
            before[after] = i
            r = get(joined + parts[after])
            put(i, absent if r is None else r * span + i)
        else:
            put(i, absent)
        p = before[i]
        if p >= 0:
            r = get(parts[p] + joined)
            put(p, absent if r is None else r * span + p)
    return [ranks[x] for x in parts if x is not None]


class Encoder:
    """Encodes texts with one vocabulary; its memory of pieces is bounded."""

    def __init__(self, path: str):
        import regex

        self.ranks = ranks_of(path)
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.known: dict[str, list[int]] = {}

    def encode_into(self, text: str, out: array) -> None:
        known, ranks = self.known, self.ranks
        pieces = self.split_ascii(text) if text.isascii() else self.split(text)
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                # A lone surrogate can't reach Spark, whose strings are UTF-8.
                ids = merge_piece(p.encode("utf-8", "replace"), ranks)
                if len(p) <= CACHED_CHARS:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[p] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text or "", out)
        return out.tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizers: str | None = None) -> DataFrame:
    """Columns ``id_col`` and ``ids`` (array<int>), a row for each row of ``df``.

    A null or empty text gives an empty list, never null; strings that look like special
    tokens are ordinary text; repeated rows stay repeated; a null id stays null; an empty
    table gives no rows. Only the two named columns are read, so further columns, also of
    the name ``ids``, don't disturb. Texts of any length are encoded whole. No shuffle:
    one pass over the scan, in Arrow batches.
    """
    path = os.path.join(tokenizers or TOKENIZERS, vocabulary)
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = source.schema["k"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            start = 0
            texts = batch.column(1)
            # Rows go out in parts of some million ids, whatever the length of the texts.
            flat, offsets = array("i"), [0]
            for row in range(batch.num_rows):
                t = texts[row].as_py()
                if t:
                    own.encode_into(t, flat)
                offsets.append(len(flat))
                if len(flat) > 2_000_000 or row == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(offsets) - 1), lists], names=[id_col, "ids"])
                    start, flat, offsets = row + 1, array("i"), [0]

    return source.mapInArrow(run, schema)


def token_counts(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokens of each encoded row."""
    return encoded.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"))


def total_tokens(ids: Column) -> Column:
    return F.sum(F.size(ids))
