"""The vector table: upsert, filters, top-k search.

Search is exact. One query becomes a scan with a top-k. Many queries and the table are
packed into blocks of fixed size; every block of queries is multiplied with every block of
the table, and only k rows per query and pair of blocks leave a task. Nothing of either
side comes to the driver, and the table is read once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.vectors import cosine
from papyrine.sources.tables import durable

#: Rows of a block of queries and of one of the table, bytes of a block's vectors at most, and decimals of a score.
QUERY_BLOCK, TABLE_BLOCK, BLOCK_BYTES, DECIMALS = 2048, 8192, 16 << 20, 6


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; aggregated before the shuffle.

    Nulls in ``order`` come first, so a row with a known time wins; among equal orders the
    row with the largest remaining columns wins, whatever the partitioning. Null keys form
    one key.
    """
    orderable = [c for c, t in rows.dtypes if c not in key and c not in order and not t.startswith(("map", "variant")) and "map<" not in t]
    if len(orderable) + len(order) + len(key) == len(rows.columns) and (order or orderable):
        # The row itself is what is compared, so it is held once.
        out = rows.groupBy(*key).agg(F.max(F.struct(*order, *orderable)).alias("_r"))
        return out.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
    by = F.struct(*order, *orderable) if order or orderable else F.lit(0)
    whole = F.struct(*[c for c in rows.columns if c not in key])
    out = rows.groupBy(*key).agg(F.max_by(whole, by).alias("_r"))
    return out.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after a batch replaced or added its keys; the batch's own last row wins by its order of columns."""
    one = latest(batch.withColumn("_b", F.lit(1)), key, ["_b"])
    return latest(table.withColumn("_b", F.lit(0)).unionByName(one), key, ["_b"]).drop("_b")


@dataclass(frozen=True)
class Condition:
    """``key`` equals a value or any of several; array columns match when they share one."""

    key: str
    values: tuple = ()

    def column(self, df: DataFrame) -> Column:
        if not self.values:
            raise ValueError(f"condition on {self.key} has no value")
        kind = df.select(self.key).schema[0].dataType
        if isinstance(kind, T.ArrayType):
            return F.arrays_overlap(F.col(self.key), F.array(*map(F.lit, self.values)).cast(kind))
        return F.col(self.key).isin(*self.values)


@dataclass(frozen=True)
class Filters:
    """All of ``must``, none of ``must_not``, at least ``least`` of ``should`` (where there are any)."""

    must: tuple[Condition, ...] = ()
    must_not: tuple[Condition, ...] = ()
    should: tuple[Condition, ...] = ()
    least: int = 1

    def column(self, df: DataFrame) -> Column:
        """One boolean column; a row that lacks a field meets no condition on it."""
        ok = F.lit(True)
        known = lambda c: F.coalesce(c.column(df), F.lit(False))
        for c in self.must:
            ok = ok & known(c)
        for c in self.must_not:
            ok = ok & ~known(c)
        if self.should:
            met = F.lit(0)
            for c in self.should:
                met = met + known(c).cast("int")
            ok = ok & (met >= self.least)
        return ok


def top_k(table: DataFrame, query: DataFrame, k: int, id_col: str, vector_col: str, filters: Filters | None = None, others_only: bool = True) -> DataFrame:
    """The k nearest rows of one query row (id, vector), by cosine, then id.

    The filter reaches the scan; the query is one row by contract, so its broadcast is of
    fixed size. Rows without a score (null, empty or zero vectors) are left out.
    """
    rows = table if filters is None else table.where(filters.column(table))
    q = F.broadcast(query.select(F.col(id_col).alias("_qi"), F.col(vector_col).alias("_qv")).limit(1))
    on = (F.col(id_col) != F.col("_qi")) if others_only else F.lit(True)
    scored = rows.join(q, on).withColumn("score", F.round(cosine(F.col(vector_col), F.col("_qv")), DECIMALS)).where("score is not null")
    return scored.drop("_qi", "_qv", vector_col).orderBy(F.desc("score"), id_col).limit(k)


def _matrix(vectors: Sequence, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = np.asarray(v, dtype=np.float64)
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def _packed(rows: DataFrame, id_col: str, vector_col: str, size: int, more: Sequence[str]) -> DataFrame:
    """``rows`` with a vector as packed blocks of at most ``size`` rows and BLOCK_BYTES of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = width = 0

        def block() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            return pd.DataFrame({"block": [pickle.dumps((pdf[id_col].to_numpy(), pdf[vector_col].tolist(), pdf[list(more)]))]})

        for pdf in batches:
            pdf = pdf[pdf[vector_col].notna()]
            width = max([width, *map(len, pdf[vector_col])]) if len(pdf) else width
            step = max(1, min(size, BLOCK_BYTES // max(8, 8 * width)))
            for k in range(0, len(pdf), step):
                held.append(pdf.iloc[k : k + step])
                n += len(held[-1])
                if n >= step:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return rows.select(id_col, vector_col, *more).mapInPandas(run, "block binary")


def top_k_batch(
    table: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, others_only: bool = True,
    admitted: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None, query_columns: Sequence[str] = (), table_columns: Sequence[str] = (), query_id: str | None = None,
) -> DataFrame:
    """query_id, id, score, rank of the k nearest rows of each query, by cosine, then id.

    ``admitted`` gives, for the named columns of a block of queries and of one of the table,
    which rows each query may find, before places are given. Scores are rounded, so ties are
    decided by id alike everywhere. Null, empty, zero or differently long vectors match
    nothing; no queries or no rows give no rows.
    """
    query_id = query_id or id_col
    kinds = queries.schema[query_id].dataType.simpleString(), table.schema[id_col].dataType.simpleString()
    q = durable(_packed(queries, query_id, vector_col, QUERY_BLOCK, query_columns), "queries")
    t = _packed(table, id_col, vector_col, TABLE_BLOCK, table_columns)
    # Pairs of blocks, not of rows.
    pairs = t.withColumnRenamed("block", "t").crossJoin(q.withColumnRenamed("block", "q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple] = {}
        for pdf in batches:
            for packed_t, packed_q in zip(pdf["t"], pdf["q"]):
                found = seen.get(hash(packed_q))
                if found is None:
                    seen.clear()
                    ids, vectors, more = pickle.loads(packed_q)
                    found = seen[hash(packed_q)] = (ids, _matrix(vectors, max(map(len, vectors), default=0)), more)
                yield _nearest(*found, *pickle.loads(packed_t), k, others_only, admitted)

    found = pairs.mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(qi, q, query_more, own, vectors, table_more, k, others_only, admitted) -> pd.DataFrame:
    """The k best rows of one block for each query of another."""
    x = _matrix(vectors, q.shape[1])
    s = np.round(q @ x.T, DECIMALS) + 0.0
    s[:, ~(np.abs(x).sum(1) > 0)] = -np.inf
    s[np.abs(q).sum(1) == 0] = -np.inf
    if others_only:
        s[qi[:, None] == own[None, :]] = -np.inf
    if admitted is not None:
        s[~admitted(query_more, table_more)] = -np.inf
    # Rows in order of id, so that a stable sort by score settles ties.
    by_id = np.argsort(own, kind="stable")
    own, s = own[by_id], s[:, by_id]
    if s.shape[1] > 4 * k:
        # All that reach the k-th best score, ties with it included.
        least = np.partition(s, -k, axis=1)[:, -k]
        a, b = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    else:
        a, b = np.nonzero(np.isfinite(s))
    order = np.lexsort((b, -s[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[place < k], b[place < k]
    return pd.DataFrame({"query_id": qi[a], "id": own[b], "score": s[a, b]})
