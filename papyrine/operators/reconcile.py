"""Three-way comparison of a collection's store, manifest and registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators import identity

COUNTS = ("chunks", "text_chunks", "table_chunks")
#: Outliers: least documents, and the shares of the median that count as low and high.
LEAST_DOCS, LOW, HIGH = 5, 0.2, 5


def store_summary(chunks: DataFrame, doc: str = "doc_id", kind: str = "chunk_type") -> DataFrame:
    """Chunks of each document: all, tables, and all the rest."""
    table = F.coalesce(F.lower(F.trim(F.col(kind))) == "table", F.lit(False))
    return chunks.groupBy(F.col(doc).alias("doc_id")).agg(F.count("*").alias("chunks"), F.count_if(~table).alias("text_chunks"), F.count_if(table).alias("table_chunks"))


def three_way(store: DataFrame, manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """All documents with the counts of each side (null where it lacks the document).

    Each side has one row per doc_id, or per collection and doc_id where it has that column.
    One shuffle a side: all joins are on these.
    """
    keys = [*identity.scope(store), "doc_id"]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"in_{p}"), *[F.col(c).cast("bigint").alias(f"{p}_{c}") for c in COUNTS])

    out = side(store, "store").join(side(manifest, "manifest"), keys, "full_outer").join(side(registry, "registry"), keys, "full_outer")
    return out.withColumns({f"in_{p}": F.coalesce(f"in_{p}", F.lit(False)) for p in ("store", "manifest", "registry")})


def presence_issues(both: DataFrame) -> DataFrame:
    """missing_doc where a side lacks the document, else count_mismatch with the fields that differ."""
    sides = ("store", "manifest", "registry")
    there = F.filter(F.array(*[F.when(F.col(f"in_{p}"), F.lit(p)) for p in sides]), lambda x: x.isNotNull())
    differs: list[Column] = []
    for c in COUNTS:
        a, b, d = (F.col(f"{p}_{c}") for p in sides)
        differs.append(F.when(~(a.eqNullSafe(b) & b.eqNullSafe(d)), F.lit(c)))
    fields = F.filter(F.array(*differs), lambda x: x.isNotNull())
    x = both.select(*identity.scope(both), "doc_id", there.alias("present_in"), fields.alias("fields"))
    x = x.withColumn("issue_type", F.when(F.size("present_in") < 3, "missing_doc").when(F.size("fields") > 0, "count_mismatch")).where("issue_type is not null")
    return x.withColumn("fields", F.when(F.col("issue_type") == "count_mismatch", F.col("fields")).otherwise(F.array().cast("array<string>")))


def sanity_issues(summary: DataFrame) -> DataFrame:
    """Implausible counts of documents: doc_id, checks.

    Outliers are judged against the median of documents with chunks, of the same collection
    where there is that column, of which there must be enough.
    """
    keys = identity.scope(summary)
    positive = summary.where("chunks > 0").groupBy(*keys).agg(F.median("chunks").alias("median"), F.count("*").alias("docs"))
    # Without collections the median is a single row.
    s = summary.join(positive, keys, "left") if keys else summary.join(F.broadcast(positive))
    on = F.coalesce((F.col("docs") >= LEAST_DOCS) & (F.col("median") > 0) & (F.col("chunks") > 0), F.lit(False))
    low, high = F.greatest(F.lit(1), F.floor(F.col("median") * LOW)), F.floor(F.col("median") * HIGH)
    checks = [
        F.when(F.col("chunks") <= 0, F.lit("no_chunks")),
        F.when((F.col("text_chunks") < 0) | (F.col("table_chunks") < 0), F.lit("negative_chunk_count")),
        F.when(F.col("text_chunks") + F.col("table_chunks") != F.col("chunks"), F.lit("count_breakdown_mismatch")),
        F.when((F.col("chunks") > 0) & (F.col("text_chunks") <= 0), F.lit("no_text_chunks")),
        F.when(on & (F.col("chunks") <= low), F.lit("unusually_low_chunk_count")),
        F.when(on & (F.col("chunks") >= high), F.lit("unusually_high_chunk_count")),
    ]
    return s.select(*keys, "doc_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("checks")).where(F.size("checks") > 0)


def metadata_mismatches(entries: DataFrame) -> DataFrame:
    """Documents whose sources give several non-blank raw values of a field: doc_id, fields.

    ``entries`` has source, doc_id and the identity fields, one row per source and document.
    """
    many = [F.when(F.count_distinct(F.nullif(F.trim(F.col(f)), F.lit(""))) > 1, F.lit(f)) for f in identity.FIELDS]
    keys = [*identity.scope(entries), "doc_id"]
    out = entries.groupBy(*keys).agg(F.count_distinct("source").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(many)])
    fields = F.filter(F.array(*[F.col(f"m{i}") for i in range(len(many))]), lambda x: x.isNotNull())
    return out.where("n > 1").select(*keys, fields.alias("fields")).where(F.size("fields") > 0)


def issues(both: DataFrame, entries: DataFrame, summaries: dict[str, DataFrame]) -> DataFrame:
    """All issues in one shape: (collection,) issue_type, source, doc_id, details (array of strings)."""
    keys = identity.scope(both)

    def shaped(df: DataFrame, kind: Column, source: Column, doc: str, details: Column) -> DataFrame:
        return df.select(*keys, kind.alias("issue_type"), source.alias("source"), F.col(doc).alias("doc_id"), details.alias("details"))

    missing = F.col("issue_type") == "missing_doc"
    out = shaped(presence_issues(both), F.col("issue_type"), F.lit(""), "doc_id", F.when(missing, F.col("present_in")).otherwise(F.col("fields")))
    out = out.unionByName(shaped(metadata_mismatches(entries), F.lit("metadata_mismatch"), F.lit(""), "doc_id", F.col("fields")))
    out = out.unionByName(shaped(identity.duplicates(entries), F.lit("duplicate_identity"), F.col("source"), "first_doc_id", F.array("field", "norm")))
    for name, s in summaries.items():
        out = out.unionByName(shaped(sanity_issues(s), F.lit("chunk_count_sanity"), F.lit(name), "doc_id", F.col("checks")))
    return out


def repair_plan(found: DataFrame) -> DataFrame:
    """What to do about each issue: action, doc_id, source, details.

    A missing document is synchronised only where the manifest has it and the registry
    doesn't; duplicates have a plan of their own.
    """
    unsynced = (F.col("issue_type") == "missing_doc") & F.array_contains("details", "manifest") & ~F.array_contains("details", "registry")
    action = (
        F.when(unsynced, "sync_registry_from_manifest")
        .when(F.col("issue_type") == "metadata_mismatch", "review_doc_metadata")
        .when(F.col("issue_type") == "count_mismatch", "review_doc_counts")
        .when(F.col("issue_type") == "chunk_count_sanity", "inspect_parser_output")
    )
    return found.withColumn("action", action).where("action is not null").select(*identity.scope(found), "action", "doc_id", "source", "details")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count("*").alias("n"))
