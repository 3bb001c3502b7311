"""Readers of parsed artifacts, files, evaluation sets, manifests and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions.text import doc_id_from_path

QUERY_SCHEMA = "id string, query string, doc_id string, expected_docs array<string>, expected_headers array<string>, labels array<string>, include_tables boolean, notes string"
ANSWER_SCHEMA = "id string, query string, expected_abstain boolean, expected_confidence_min string, expected_doc_ids array<string>, notes string"
DOC_SCHEMA = "doc_id string, source_file string, local_file string, pdf_path string, chunk_count int, text_chunk_count int, table_chunk_count int, parser string, ingestion_version string, chunker_version string, chunking_version string, source_sha256 string, file_size_bytes bigint"


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below a path with their identity: path, doc_id, content, source_sha256, file_size_bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", doc_id_from_path(F.col("path")).alias("doc_id"), "content", F.sha2("content", 256).alias("source_sha256"), F.col("length").alias("file_size_bytes"))


def markdown_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Whole markdown files: doc_id, source_path, markdown_text."""
    texts = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return texts.select(doc_id_from_path(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("source_path"), F.col("value").alias("markdown_text"))


def table_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Sibling files ``<stem>.table_NN.csv|json`` as doc_stem, table_index, csv, json (one row per table)."""
    texts = spark.read.option("pathGlobFilter", "*.table_*.{csv,json}").option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = texts.select(
        F.regexp_extract(name, r"^(.*)\.table_\d+\.(?:csv|json)$", 1).alias("doc_stem"), F.regexp_extract(name, r"\.table_(\d+)\.", 1).cast("int").alias("table_index"),
        F.regexp_extract(name, r"\.(csv|json)$", 1).alias("kind"), "value",
    )
    return rows.groupBy("doc_stem", "table_index").agg(F.max(F.when(F.col("kind") == "csv", F.col("value"))).alias("csv"), F.max(F.when(F.col("kind") == "json", F.col("value"))).alias("json"))


def _checked(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows numbered and named, failing loudly where a needed field is blank."""
    for c in needed:
        df = df.withColumn(c, F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.raise_error(F.lit(f"evaluation query without {c}"))).otherwise(F.col(c)))
    return df


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval queries of a JSON array; blank expectations are dropped."""
    df = _checked(spark.read.schema(QUERY_SCHEMA).option("multiLine", "true").json(path), ["query"])
    tidy = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({c: tidy(c) for c in ("expected_docs", "expected_headers", "labels")})


def answer_queries(spark: SparkSession, path: str) -> DataFrame:
    df = _checked(spark.read.schema(ANSWER_SCHEMA).option("multiLine", "true").json(path), ["id", "query"])
    bad = F.col("expected_confidence_min").isNotNull() & ~F.upper("expected_confidence_min").isin("HIGH", "MEDIUM", "LOW", "INSUFFICIENT")
    return df.withColumn("expected_confidence_min", F.when(bad, F.raise_error(F.lit("unknown confidence"))).otherwise(F.upper("expected_confidence_min")))


def manifest_file(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest JSON object, with versions falling back to the manifest's own."""
    schema = T._parse_datatype_string(f"collection string, parser string, ingestion_version string, chunker_version string, chunking_version string, docs array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in DOC_SCHEMA.split(','))}>>")
    m = spark.read.schema(schema).option("multiLine", "true").json(path)
    e = m.select("collection", F.struct("parser", "ingestion_version", "chunker_version", "chunking_version").alias("m"), F.explode("docs").alias("d"))
    own = ("parser", "ingestion_version", "chunker_version", "chunking_version")
    names = [x.split()[0] for x in DOC_SCHEMA.split(", ")]
    return e.select("collection", *[F.coalesce(f"d.{c}", f"m.{c}").alias(c) if c in own else F.col(f"d.{c}").alias(c) for c in names])


def registry_file(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry JSON object (collections -> docs -> entry), also of the older layout without ``docs``."""
    text = spark.read.text(path, wholetext=True)
    entry = T._parse_datatype_string(DOC_SCHEMA)
    outer = text.select(F.explode(F.from_json(F.get_json_object("value", "$.collections"), "map<string,string>")).alias("collection", "body"))
    docs = F.coalesce(F.from_json(F.get_json_object("body", "$.docs"), "map<string,string>"), F.map_filter(F.from_json("body", "map<string,string>"), lambda _, v: v.startswith("{")))
    return outer.select("collection", F.explode(docs).alias("doc_key", "e")).select("collection", "doc_key", F.from_json("e", entry).alias("e")).select("collection", "doc_key", "e.*")
