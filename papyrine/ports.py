"""Extension points with local, deterministic defaults: parser, embedder, re-ranker, model.

Each takes a plain function over pandas data, so that any library can be plugged in; it
runs in Arrow batches. An embedding service is called again with growing pauses when it
fails for a while.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WORDS = re.compile("[a-z0-9]+").findall
DIMENSIONS, BATCH, TRIES, PAUSE = 64, 64, 3, 1.0


@lru_cache(1 << 16)
def _slot(word: str) -> tuple[int, int]:
    h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return h % DIMENSIONS, 1 if h // 256 % 2 else -1


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Signed counts of hashed words; the same text always gives the same vector.

    Cosine doesn't look at lengths, so vectors stay whole numbers.
    """
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in _WORDS((t or "").lower()):
            at, sign = _slot(w)
            out[i, at] += sign
    return out.tolist()


def with_retry(call: Callable, tries: int = TRIES, pause: float = PAUSE, again: Callable[[Exception], bool] = lambda e: isinstance(e, (TimeoutError, ConnectionError))) -> Callable:
    """``call`` repeated after errors that may pass, each pause twice the last."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:
                if k == tries - 1 or not again(e):
                    raise
                time.sleep(pause * 2**k)

    return run


def embedder(function: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function from texts to vectors; nulls are embedded as empty texts."""
    safe = with_retry(function)

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [t or "" for t in s]
            out: list[list[float]] = []
            for k in range(0, len(texts), batch):
                out += safe(texts[k : k + batch])
            yield pd.Series(out, dtype=object)

    return embed


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], n: int, query: str = "query", content: str = "content") -> DataFrame:
    """The n candidates of each query with the highest score, ties in the order they came (``place``)."""
    score = F.pandas_udf(scorer, "double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "place")
    return candidates.withColumn("score", score(F.col(query), F.col(content))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def parse_files(files: DataFrame, converter: Callable[[bytes, str], str]) -> DataFrame:
    """doc_id, path, markdown_text and error of each file; a failing file gives its error, not a failed job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.doc_id, r.path, converter(r.content, r.path), None))
                except Exception as e:
                    rows.append((r.doc_id, r.path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "markdown_text", "error"])

    return files.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, markdown_text string, error string")
