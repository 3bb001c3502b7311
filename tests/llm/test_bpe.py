import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def brute(piece: bytes, ranks) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaabc erst<|>012\n'é字", max_size=60))
def test_merge_against_brute_force(text):
    ranks = bpe.ranks_of(PATH)
    piece = text.encode()
    want = [ranks[piece]] if piece in ranks else brute(piece, ranks)
    assert bpe.merge_piece(piece, ranks) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_against_the_public_library(text):
    tiktoken = pytest.importorskip("tiktoken")
    text = text.encode("utf-8", "ignore").decode()
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
    assert bpe.encoder(PATH).encode(text) == enc.encode_ordinary(text)


def test_long_pieces_and_bounded_memory(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    own = bpe.Encoder(PATH)
    rng = random.Random(1)
    for alphabet in ("ACGT", "xyz0", "a", "=-"):
        t = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert own.encode(t) == reference.encode_ordinary(t)
    assert len(own.known) <= 10


def test_rows(spark):
    rows = [(1, "a <|endoftext|> b"), (2, None), (3, ""), (None, " "), (1, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df).collect()), key=repr)
    own = bpe.encoder(PATH)
    assert got == sorted(((i, own.encode(t)) for i, t in rows), key=repr)
    assert bpe.encode(df.limit(0)).count() == 0


def test_round_trip(spark, data):
    back = {i: b for b, i in bpe.ranks_of(PATH).items()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in docs.join(bpe.encode(docs), "doc_id").collect():
        assert b"".join(back[i] for i in r.ids).decode() == (r.text or "")
