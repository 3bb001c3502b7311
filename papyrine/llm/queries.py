"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import bpe, intake, leakage, quality, scan, split
from papyrine.llm.oracle import ORACLE as ORACLE  # noqa: F401
from papyrine.llm.oracle import WORD_STATISTICS
from papyrine.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Everything that scanning left in the papers, by line."""
    return scan.findings(load(spark, d, "parsed_documents"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """Every paper as continuous readable paragraphs."""
    return scan.repaired(load(spark, d, "parsed_documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rejected intake items with the accepted item each repeats."""
    return intake.rejected(load(spark, d, "intake_items"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized chunk and document."""
    return split.pieces(split.oversized(load(spark, d, "chunks"), load(spark, d, "parsed_documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized items and the kind of boundary they are cut at."""
    return p5_pieces(spark, d).where("piece_no = 1").select("item_kind", "item_id", "cut")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by the byte-level vocabulary."""
    return bpe.encode(load(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document."""
    return bpe.token_counts(p6_ids(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a run of a passage's words, with the item."""
    return p7_matches(spark, d).where("exact").select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Exact leaks and paraphrases with their evidence."""
    return leakage.matches(load(spark, d, "documents"), load(spark, d, "eval_passages"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly list, table or junk."""
    return p8_kinds(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics and kind."""
    return quality.classified(load(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics."""
    return quality.with_statistics(load(spark, d, "documents"))


def p8_words(spark: SparkSession, d: str) -> DataFrame:
    """Those statistics of every document that count words and letters."""
    return p8_statistics(spark, d).select(*WORD_STATISTICS)


QUERIES = {f.__name__: f for f in (p1_found, p1_text, p4_found, p5_found, p5_pieces, p6_ids, p6_counts, p7_found, p7_matches, p7_items, p8_found, p8_kinds, p8_statistics, p8_words)}
