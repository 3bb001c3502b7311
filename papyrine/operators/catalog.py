"""Manifest, registry and versions of collections, and the switch of an alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import collapse
from papyrine.operators import identity, reconcile
from papyrine.operators.store import latest


def manifest_entries(chunks: DataFrame, identity: DataFrame, versions: dict[str, str]) -> DataFrame:
    """One entry per document: counts from its chunks, its identity, and versions."""
    counts = reconcile.store_summary(chunks)
    out = counts.select("doc_id", F.col("chunks").alias("chunk_count"), F.col("text_chunks").alias("text_chunk_count"), F.col("table_chunks").alias("table_chunk_count"))
    out = out.join(identity, "doc_id", "left")
    return out.withColumns({k: F.lit(v) for k, v in versions.items()})


def current_manifest(entries: DataFrame) -> DataFrame:
    """The current entry per collection and document (collapsed, any case), by time of update."""
    keyed = entries.withColumn("doc_key", collapse(F.lower("doc_id"))).where("doc_key <> ''")
    return latest(keyed, ["collection", "doc_key"], ["updated_at", "entry_id"])


def totals(manifest: DataFrame) -> DataFrame:
    """Documents and chunks per collection."""
    return manifest.groupBy("collection").agg(F.count("*").alias("doc_count"), F.sum("chunk_count").alias("chunk_count"), F.sum("text_chunk_count").alias("text_chunk_count"), F.sum("table_chunk_count").alias("table_chunk_count"))


def upsert_entries(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest after entries replaced or added their documents."""
    keep = manifest.join(entries.select("collection", "doc_id"), ["collection", "doc_id"], "left_anti")
    return keep.unionByName(entries, allowMissingColumns=True)


def chunker_version(chunker: Column, legacy: Column) -> Column:
    """The chunker's version, or its legacy field where that is absent."""
    return F.coalesce(chunker, legacy)


def version_issues(manifest: DataFrame, ingestion: str, chunking: str) -> DataFrame:
    """Entries made with other versions: collection, doc_id, issues. Blank versions are tolerated."""
    known = lambda c: F.coalesce(F.trim(c), F.lit(""))
    i, k = known(F.col("ingestion_version")), known(chunker_version(F.col("chunker_version"), F.col("chunking_version")))
    found = F.filter(
        F.array(F.when((i != "") & (i != ingestion), F.lit("ingestion_version")), F.when((k != "") & (k != chunking), F.lit("chunker_version"))), lambda x: x.isNotNull()
    )
    return manifest.select("collection", "doc_id", found.alias("issues")).where(F.size("issues") > 0)


def create_collection(df: DataFrame, name: str, recreate: bool = False) -> None:
    """Write a collection's table; an existing one is refused unless it is to be recreated."""
    df.write.mode("overwrite" if recreate else "errorifexists").saveAsTable(name)


def promote(spark: SparkSession, alias: str, table: str) -> None:
    """Point an alias to a table, in one step; the table must exist."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no such collection: {table}")
    name = "`" + alias.replace("`", "``") + "`"
    spark.table(table).createOrReplaceTempView(alias) if spark.conf.get("spark.sql.catalogImplementation") == "in-memory" else spark.sql(f"create or replace view {name} as select * from {table}")


def _same_document(doc_id: str) -> Column:
    """Whether a row is of that document; a row without doc_id is of none."""
    return F.coalesce(collapse(F.lower("doc_id")) == collapse(F.lower(F.lit(doc_id))), F.lit(False))


def document_rows(table: DataFrame, doc_id: str) -> DataFrame:
    """One document's rows, as they are kept before it is replaced."""
    return table.where(_same_document(doc_id))


def replace_document(table: DataFrame, doc_id: str, fresh: DataFrame) -> DataFrame:
    """A collection with one document's chunks replaced; refused where the new ones are none.

    Rows without doc_id stay, and so do columns that the new rows lack (as null).
    """
    if fresh.isEmpty():
        raise ValueError(f"no chunks to replace {doc_id} by")
    return table.where(~_same_document(doc_id)).unionByName(fresh, allowMissingColumns=True)


def restore_document(table: DataFrame, doc_id: str, backup: DataFrame) -> DataFrame:
    """A collection with one document's rows as they were kept; none, where it had none."""
    return table.where(~_same_document(doc_id)).unionByName(backup, allowMissingColumns=True)


def canonical_doc_id(entries: DataFrame, doc_id: str, source_sha256: str) -> str:
    """The id under which a file's content is known, else the given one."""
    asked = entries.sparkSession.createDataFrame([(doc_id, source_sha256)], "doc_id string, source_sha256 string")
    ordinal = entries if "ordinal" in entries.columns else entries.withColumn("ordinal", F.lit(0))
    return identity.canonical_ids(asked, ordinal).first().canonical_doc_id


def failures(results: DataFrame) -> DataFrame:
    """doc_id, path, stage and error of the files that failed to parse; ``results`` as ``ports.parse_files`` gives them."""
    return results.where("error is not null").select("doc_id", "path", F.lit("parse").alias("stage"), "error")


REGISTRY = {"pdf_path": "local_file", "source_file": "source_file", "chunks": "chunk_count", "text_chunks": "text_chunk_count", "table_chunks": "table_chunk_count", "parser": "parser", "source_sha256": "source_sha256", "file_size_bytes": "file_size_bytes", "ingestion_version": "ingestion_version"}


def registry_from_manifest(manifest: DataFrame) -> DataFrame:
    """Registry entries of collections, one for each current manifest entry.

    Texts are trimmed and blank where unknown, counts 0; the chunker's version comes from its
    legacy field where it is absent. Documents without an id are left out.
    """
    texts = {k for k, v in REGISTRY.items() if dict(manifest.dtypes).get(v) == "string"}
    value = lambda k, v: F.coalesce(F.trim(v), F.lit("")) if k in texts else F.coalesce(F.col(v), F.lit(0))
    version = F.coalesce(F.trim(chunker_version(F.col("chunker_version"), F.col("chunking_version"))), F.lit(""))
    return manifest.where(F.trim("doc_id") != "").select("collection", F.trim("doc_id").alias("doc_id"), *[value(k, v).alias(k) for k, v in REGISTRY.items()], version.alias("chunker_version"))


def registry_totals(registry: DataFrame) -> DataFrame:
    """Documents and chunks of each collection of a registry."""
    return registry.groupBy("collection").agg(F.count("*").alias("doc_count"), F.sum("chunks").cast("bigint").alias("chunk_count"))


def refused_entries(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose identity another document of the same collection already has.

    collection, doc_id, field, existing_doc_id, by one equi-join over collection, field and
    value. An entry of a document that the registry has replaces it and isn't refused.
    """

    def keys(e: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("field"), identity.normalized(f, F.col(c)).alias("norm")) for f, c in (("source_file", "source_file"), ("local_file", "pdf_path"), ("source_sha256", "source_sha256"))])
        return e.select("collection", F.trim("doc_id").alias("doc_id"), F.explode(each).alias("e")).select("collection", "doc_id", "e.*").where("norm is not null")

    # The two smallest ids of a value are enough to find one that isn't the entry's own.
    have = keys(registry).groupBy("collection", "field", "norm").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("two"))
    other = F.when(F.col("one") != F.col("doc_id"), F.col("one")).when(F.col("two") != F.col("doc_id"), F.col("two"))
    return keys(entries).join(have, ["collection", "field", "norm"]).select("collection", "doc_id", "field", other.alias("existing_doc_id")).where("existing_doc_id is not null").distinct()


def upsert_registry(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """The registry after entries replaced or added their documents; raises where one is refused."""
    bad = refused_entries(registry, entries).take(1)
    if bad:
        raise ValueError(f"{bad[0].doc_id}: {bad[0].field} belongs to {bad[0].existing_doc_id}")
    return upsert_entries(registry, entries)


def alias_entries(manifest: DataFrame, alias: str) -> DataFrame:
    """A collection's manifest under an alias."""
    return manifest.withColumn("collection", F.lit(alias))
