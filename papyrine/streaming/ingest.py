"""Incremental ingestion: files that arrive become chunks in a collection's table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.operators.chunking import chunk_documents
from papyrine.operators.store import latest
from papyrine.sources.tables import Files

#: Folders that a streamed table's documents are spread over; a batch rewrites those it touches.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def stream_chunks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100, buckets: int = BUCKETS) -> StreamingQuery:
    """Parsed documents arriving as parquet below ``source`` are chunked and merged into ``target``.

    A batch replaces all chunks of the documents it has again, so that none of an earlier,
    longer version stays; of a document that a batch has twice the last by ``parsed_at``
    counts. Documents lie in buckets. Only the buckets that a batch touches are written anew,
    beside the old ones, and then a list of the current folders is named, so a batch that is
    repeated after a failure gives the same table; folders that no current list names are
    removed after the next batch.
    """
    files = Files(spark, target)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        arrived = latest(batch, ["doc_id"], ["parsed_at"] if "parsed_at" in batch.columns else [])
        fresh = chunk_documents(arrived).withColumn("bucket", _bucket(buckets))
        touched = sorted(r[0] for r in arrived.select(_bucket(buckets)).distinct().collect())
        before = _folders(files, number)
        old = _read(session, target, {b: v for b, v in before.items() if int(b) in touched})
        if old is not None:
            docs = arrived.select(F.col("doc_id").alias("_d")).distinct()
            kept = old.join(docs, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
            fresh = kept.withColumn("bucket", _bucket(buckets)).unionByName(fresh, allowMissingColumns=True)
        version = f"v={number:012d}"
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{version}")
        there = {n.split("=")[1] for n in files.names(version) if n.startswith("bucket=")}
        now = {b: v for b, v in before.items() if int(b) not in touched} | {b: version for b in there}
        files.write(f"current/{number:012d}.json", json.dumps(now))
        used = set(now.values()) | set(before.values()) | {version}
        for name in files.names():
            if name.startswith("v=") and name not in used:
                files.remove(name)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(files: Files, below: int | None = None) -> dict[str, str]:
    """The version folder of each bucket, as the newest list before batch ``below`` has it."""
    lists = [n for n in files.names("current") if n.endswith(".json") and (below is None or int(n.split(".")[0]) < below)]
    return json.loads(files.read(f"current/{lists[-1]}")) if lists else {}


def _read(spark: SparkSession, target: str, folders: dict[str, str]) -> DataFrame | None:
    return spark.read.parquet(*[f"{target}/{v}/bucket={b}" for b, v in sorted(folders.items())]) if folders else None


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """A streamed table as its last complete batch left it, or None."""
    return _read(spark, target, _folders(Files(spark, target)))
