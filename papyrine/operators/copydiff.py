"""Differences between two copies of a dataset, by invertible Bloom lookup tables.

Each side is reduced to its current row per key. A row becomes one element, a 64-bit hash
of key and compared fields; the elements of a bucket of keys are added to a small table of
cells, each holding a count and XORs of element, check and key hash. Subtracting the two
sides' tables cancels every row that both hold alike, and peeling what is left reveals the
key hashes of the rest, whose rows alone are then fetched and compared field by field.

Only the cells, of fixed number per bucket, meet across the two copies. A bucket with more
differences than its cells can reveal isn't peeled; its rows alone go through finer buckets
again, and those of a bucket that still can't be peeled are all fetched, so the result is
the same whatever the tables' size. ``peelings`` reports how many buckets that were.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.folding import folded
from papyrine.sources.tables import durable

#: Keys a bucket holds on average, cells of each of its three sub-tables, and buckets
#: peeled together in one call. A bucket so reveals up to about 1.2 * CELLS * 3 / 1.5
#: elements; a row that differs counts twice.
KEYS_PER_BUCKET, CELLS, BUCKETS_AT_ONCE = 512, 96, 64
#: Peelings at most, and how many times finer the buckets of each further one are.
PEELINGS, FINER = 3, 16
_LOW31 = 0x7FFFFFFF


def number_text(c: Column) -> Column:
    """A count in any spelling as one canonical text; null for blank.

    Blanks, a plus sign, leading zeros and a zero fraction don't matter. Text that is no
    number stays as it is, marked, and so differs from every number.
    """
    t = F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))
    n = t.try_cast("decimal(38,9)").cast("string")
    return F.when(t != "", F.coalesce(n, F.concat(F.lit("text:"), F.lower(t))))


def current_rows(df: DataFrame, scope: str, key: Column, fields: dict[str, Column], at: str, order: str) -> DataFrame:
    """One row per scope and key: that with the latest ``at``, among equals the largest ``order``.

    Aggregated before the shuffle, so that a key with many outdated rows sends one row
    per partition. Rows with an unknown key can't be matched and are left out.
    """
    values = F.struct(*[c.alias(n) for n, c in fields.items()])
    latest = (
        df.select(F.col(scope).alias("scope"), key.alias("key"), F.struct(F.col(at), F.col(order)).alias("o"), values.alias("v"))
        .where(F.col("key").isNotNull())
        .groupBy("scope", "key")
        .agg(F.max_by("v", "o").alias("v"))
    )
    rows = latest.select("scope", "key", *[F.col(f"v.{n}").alias(n) for n in fields])
    parts = [F.coalesce(F.col(n), F.lit("\x00")) for n in fields]
    return rows.withColumns({"k1": F.xxhash64(F.coalesce("scope", F.lit("\x00")), "key"), "e1": F.xxhash64(F.coalesce("scope", F.lit("\x00")), "key", *parts)})


def _check(e: Column) -> Column:
    """A non-linear 62-bit check of an element, computed alike in ``_check_np``."""
    return (e.bitwiseAND(F.lit(_LOW31))) * (F.shiftrightunsigned(e, 32).bitwiseAND(F.lit(_LOW31)))


def _check_np(e: np.ndarray) -> np.ndarray:
    u = e.view(np.uint64)
    return ((u & np.uint64(_LOW31)) * ((u >> np.uint64(32)) & np.uint64(_LOW31))).view(np.int64)


def _positions_np(e: np.ndarray, cells: int) -> list[np.ndarray]:
    u = e.view(np.uint64)
    return [i * cells + (((u >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)) % np.uint64(cells)).astype(np.int64) for i in range(3)]


def lookup_cells(rows: DataFrame, buckets: int, cells: int, sign: int) -> DataFrame:
    """Cells (bucket, cell) of the signed table of one side. Partial sums precede the shuffle."""
    at = F.array(*[F.lit(i * cells) + F.shiftrightunsigned("e1", 21 * i).bitwiseAND(F.lit(0x1FFFFF)) % cells for i in range(3)])
    return rows.select(F.pmod("k1", F.lit(buckets)).alias("bucket"), "k1", "e1", F.explode(at).alias("cell")).select(
        "bucket", "cell", "k1", "e1", _check(F.col("e1")).alias("c1"), F.lit(sign).cast("long").alias("n")
    )


def peel(pdf: pd.DataFrame, cells: int) -> pd.DataFrame:
    """Reveal the elements of subtracted cells, for several buckets at once.

    Gives key hashes of the elements found, and a row with ``failed`` for each bucket
    whose cells aren't all empty in the end.
    """
    buckets, inverse = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
    width = 3 * cells
    size = len(buckets) * width
    n, e, c, k = (np.zeros(size, dtype=np.int64) for _ in range(4))
    at = inverse * width + pdf["cell"].to_numpy()
    n[at], e[at], c[at], k[at] = pdf["n"], pdf["e1"], pdf["c1"], pdf["k1"]
    found_bucket, found_key = [], []
    for _ in range(size):
        pure = np.flatnonzero((np.abs(n) == 1) & (c == _check_np(e)))
        if not len(pure):
            break
        # An element seen in several pure cells is taken once.
        base = (pure // width) * width
        _, first = np.unique(np.stack([base, e[pure]]), axis=1, return_index=True)
        pure, base = pure[first], base[first]
        element, key, sign = e[pure], k[pure], n[pure]
        check = _check_np(element)
        found_bucket.append(base // width)
        found_key.append(key)
        for p in _positions_np(element, cells):
            np.subtract.at(n, base + p, sign)
            np.bitwise_xor.at(e, base + p, element)
            np.bitwise_xor.at(c, base + p, check)
            np.bitwise_xor.at(k, base + p, key)
    left = np.unique(np.flatnonzero((n != 0) | (e != 0) | (c != 0) | (k != 0)) // width)
    own = np.concatenate(found_bucket) if found_bucket else np.empty(0, np.int64)
    keys = np.concatenate(found_key) if found_key else np.empty(0, np.int64)
    good = ~np.isin(own, left)
    return pd.DataFrame(
        {
            "bucket": np.concatenate([buckets[own[good]], buckets[left]]).astype(np.int64),
            "k1": np.concatenate([keys[good], np.zeros(len(left), np.int64)]),
            "failed": np.concatenate([np.zeros(good.sum(), bool), np.ones(len(left), bool)]),
        }
    )


def _peeled(left: DataFrame, right: DataFrame, buckets: int, cells: int) -> DataFrame:
    """bucket, k1, failed of one peeling of two sides' rows."""
    both = lookup_cells(left, buckets, cells, 1).unionAll(lookup_cells(right, buckets, cells, -1))
    summed = both.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in ("e1", "c1", "k1")])
    live = summed.where("n <> 0 or e1 <> 0 or c1 <> 0 or k1 <> 0")
    group = F.floor(F.col("bucket") / BUCKETS_AT_ONCE).cast("long")
    return durable(live.groupBy(group.alias("g")).applyInPandas(lambda pdf: peel(pdf, cells), "bucket long, k1 long, failed boolean"), "peeled")


def peelings(left: DataFrame, right: DataFrame, cells: int = CELLS, keys_per_bucket: int = KEYS_PER_BUCKET) -> tuple[list[DataFrame], DataFrame | None, list[tuple[int, int, int]]]:
    """Key hashes that peeling revealed, rows' buckets that failed to the last, and a report.

    ``left`` and ``right`` are stored. The first number of buckets follows from the larger
    side, so an empty side changes nothing. The second result (bucket, with the number of
    buckets it belongs to in the report's last entry) is None where all could be peeled;
    report entries are (number of the peeling, buckets, failed buckets).
    """
    buckets = max(1, max(left.count(), right.count()) // keys_per_bucket)
    found: list[DataFrame] = []
    report: list[tuple[int, int, int]] = []
    failed = None
    for k in range(PEELINGS):
        if failed is not None:
            a, b = (_in_buckets(x, failed, buckets) for x in (left, right))
            buckets *= FINER
        else:
            a, b = left, right
        got = _peeled(a, b, buckets, cells)
        found.append(got.where("not failed").select("k1"))
        failed = got.where("failed").select("bucket").distinct()
        n = failed.count()
        report.append((k + 1, buckets, n))
        if not n:
            return found, None, report
    return found, failed, report


def _in_buckets(rows: DataFrame, chosen: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod("k1", F.lit(buckets))).join(chosen, "bucket", "left_semi").drop("bucket")


def differing(left: DataFrame, right: DataFrame, fields: Sequence[str], cells: int = CELLS, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Full outer pairs of current rows whose element isn't on both sides.

    ``left`` and ``right`` come from ``current_rows``. Columns: scope, key, in_left,
    in_right, and l_/r_ of each field. Rows that both hold alike never reach the final join,
    but for those of buckets that couldn't be peeled.
    """
    left, right = durable(left, "copyleft"), durable(right, "copyright")
    found, failed, report = peelings(left, right, cells, keys_per_bucket)
    keys = found[0]
    for f in found[1:]:
        keys = keys.unionByName(f)
    keys = keys.distinct()

    def fetch(rows: DataFrame) -> DataFrame:
        out = rows.join(keys, "k1", "left_semi")
        if failed is None:
            return out
        return out.unionByName(_in_buckets(rows, failed, report[-1][1]).join(keys, "k1", "left_anti"))

    a, b = fetch(left).alias("a"), fetch(right).alias("b")
    on = F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, on, "full_outer").select(
        F.coalesce("a.scope", "b.scope").alias("scope"),
        F.coalesce("a.key", "b.key").alias("key"),
        F.col("a.key").isNotNull().alias("in_left"),
        F.col("b.key").isNotNull().alias("in_right"),
        *[F.col(f"a.{f}").alias(f"l_{f}") for f in fields],
        *[F.col(f"b.{f}").alias(f"r_{f}") for f in fields],
    )


def field_differences(pairs: DataFrame, fields: Sequence[str], left_missing: str, right_missing: str) -> DataFrame:
    """A row for each missing entry and each differing field: scope, key, field, left, right."""
    entry = [
        F.when(~F.col("in_left"), F.struct(F.lit(left_missing).alias("field"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))),
        F.when(~F.col("in_right"), F.struct(F.lit(right_missing).alias("field"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))),
    ]
    for f in fields:
        a, b = F.col(f"l_{f}"), F.col(f"r_{f}")
        entry.append(F.when(F.col("in_left") & F.col("in_right") & ~a.eqNullSafe(b), F.struct(F.lit(f).alias("field"), a.alias("left"), b.alias("right"))))
    return pairs.select("scope", "key", F.explode(F.filter(F.array(*entry), lambda x: x.isNotNull())).alias("d")).select("scope", "key", "d.field", "d.left", "d.right")


COUNTS = {"chunk_count": "chunks", "text_chunk_count": "text_chunks", "table_chunk_count": "table_chunks"}
FIELDS = (*COUNTS, "source_sha256")


def _both_sides(manifest: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = {m: number_text(F.col(m)) for m in COUNTS} | {"source_sha256": folded(F.col("source_sha256"))}
    two = {m: number_text(F.col(r)) for m, r in COUNTS.items()} | {"source_sha256": folded(F.col("source_sha256"))}
    return (
        current_rows(manifest, "collection", folded(F.col("doc_id")), one, "updated_at", "entry_id"),
        current_rows(registry, "collection", folded(F.col("doc_id")), two, "updated_at", "entry_id"),
    )


def manifest_registry_differences(manifest: DataFrame, registry: DataFrame, cells: int = CELLS, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Every entry missing on one side and every differing field of manifest and registry.

    Columns collection, doc_id (folded), field, manifest_value, registry_value. Nulls and
    blanks of a field are equal to each other and differ from any value; entries with an
    unknown doc_id are left out, having no key to match by; a null collection matches a
    null collection; repeated rows count once; among rows with the same updated_at that of
    the larger entry_id counts; an empty side makes every entry of the other missing.
    """
    a, b = _both_sides(manifest, registry)
    out = field_differences(differing(a, b, FIELDS, cells, keys_per_bucket), FIELDS, "missing_in_manifest", "missing_in_registry")
    return out.select(F.col("scope").alias("collection"), F.col("key").alias("doc_id"), "field", F.col("left").alias("manifest_value"), F.col("right").alias("registry_value"))


def peeling_report(manifest: DataFrame, registry: DataFrame, cells: int = CELLS, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """peeling, buckets, failed_buckets: how far the lookup tables revealed the differences."""
    a, b = (durable(x, "copy") for x in _both_sides(manifest, registry))
    return manifest.sparkSession.createDataFrame(peelings(a, b, cells, keys_per_bucket)[2], "peeling int, buckets long, failed_buckets long")
