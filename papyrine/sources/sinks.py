"""Sinks: exports of collections and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT = ("id", "doc_id", "chunk_type", "parent_header", "page_number", "content")


def payload(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All other columns of a chunk as one JSON text, nulls left out."""
    return F.to_json(F.struct(*(columns or [c for c in df.columns if c not in EXPORT])))


def export_records(chunks: DataFrame, doc_id: str | None = None, vector: str | None = None) -> DataFrame:
    """Flat export rows: the main columns, the payload as JSON, the vector as JSON where asked for."""
    rows = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
    extra = [c for c in rows.columns if c not in EXPORT and c != vector]
    cols = [F.col(c) for c in EXPORT if c in rows.columns] + [payload(rows, extra).alias("payload")]
    if vector:
        cols.append(F.to_json(F.col(vector).cast("array<double>")).alias("vector"))
    return rows.select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns are joined by a bar, other nested ones are JSON."""
    flat = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            flat.append(F.array_join(F.col(f.name), " | ").alias(f.name))
        elif kind.startswith(("array", "struct", "map")):
            flat.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            flat.append(F.col(f.name))
    df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_artifacts(documents: DataFrame, path: str) -> None:
    """Parsed documents as parquet, parted by parser."""
    documents.write.mode("overwrite").partitionBy("parser").parquet(path)
