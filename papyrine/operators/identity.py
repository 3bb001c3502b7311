"""Identities of documents: duplicates, canonical ids, availability, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import collapse, identity_path, identity_text

FIELDS = ("source_file", "local_file", "source_sha256")


def normalized(field: str, c: Column) -> Column:
    """How values of a field compare; blank is unknown (null)."""
    return identity_path(c) if field == "local_file" else identity_text(c)


def identities(rows: DataFrame, doc: str, fields: dict[str, str], order: str | None = None) -> DataFrame:
    """doc_id and, of each field, the first non-blank value of a document's rows in order.

    ``fields`` maps the names source_file, local_file, source_sha256 to columns. Documents
    with a blank id are left out. Aggregates before the shuffle.
    """
    at = F.col(order) if order else F.lit(0)
    def first(c):
        return F.min_by(F.trim(F.col(c)), F.when(F.trim(F.col(c)) != "", F.struct(at.alias("o"), F.trim(F.col(c)).alias("v"))))

    d = rows.withColumn("doc_id", collapse(F.col(doc))).where("doc_id <> ''")
    return d.groupBy("doc_id").agg(*[first(c).alias(f) for f, c in fields.items()])


def scope(df: DataFrame, *more: str) -> list[str]:
    """Columns that entries are told apart by where they have them: the collection first."""
    return [c for c in ("collection", *more) if c in df.columns]


def long_form(entries: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """A row for each known identity value: doc_id, field, value, norm (and collection, source, ordinal, if there)."""
    keep = scope(entries, "source", "ordinal")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value"), normalized(f, F.col(f)).alias("norm")) for f in fields])
    return entries.select("doc_id", *keep, F.explode(each).alias("e")).select("doc_id", *keep, "e.*").where("norm is not null and doc_id is not null")


def claims(entries: DataFrame, by_source: bool = True) -> DataFrame:
    """Distinct documents of each identity value (field, norm), within collection and source where there are any."""
    keys = scope(entries, "source") if by_source else scope(entries)
    return long_form(entries).select(*keys, "field", "norm", "doc_id").distinct()


def duplicates(entries: DataFrame, by_source: bool = True) -> DataFrame:
    """Identity values that several documents claim: field, norm, n_docs, first_doc_id.

    One row a value, whatever the number of its documents; ``claims`` has these. The distinct
    pairs come first, so a value on a third of all rows is counted after each task has
    reduced its part.
    """
    pairs = claims(entries, by_source)
    keys = [c for c in pairs.columns if c != "doc_id"]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id")).where("n_docs > 1")


def duplicate_members(entries: DataFrame, by_source: bool = True) -> DataFrame:
    """The documents of each value in ``duplicates``: field, norm, doc_id."""
    pairs = claims(entries, by_source)
    keys = [c for c in pairs.columns if c != "doc_id"]
    return pairs.join(duplicates(entries, by_source).select(*keys), keys, "left_semi")


def _weighed(entries: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents of each value with the number of their sources, and the values with the most of these."""
    keys = [*scope(entries), "field", "norm"]
    seen = long_form(entries).select(*keys, "source", "doc_id").distinct()
    counts = seen.groupBy(*keys, "doc_id").agg(F.count("*").alias("sources"))
    # The two most claimed documents decide; no list of documents is gathered.
    best = counts.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.max_by("doc_id", F.struct("sources", "doc_id")).alias("top"), F.max("sources").alias("most"))
    ties = counts.join(best.select(*keys, "most"), keys).where("sources = most").groupBy(*keys).agg(F.count("*").alias("tied"))
    plan = best.where("n_docs > 1").join(ties, keys).select(*keys, "n_docs", F.when(F.col("tied") == 1, F.col("top")).alias("keep_doc_id"))
    return counts, plan, keys


def cleanup_plan(entries: DataFrame) -> DataFrame:
    """For each value that several documents claim: keep the one in most sources, or review.

    ``entries`` has source, doc_id and the identity fields, and may have a collection, within
    which values are compared. Columns: field, norm, action, keep_doc_id (null for a tie),
    n_docs; ``cleanup_members`` says what becomes of each document.
    """
    _, plan, keys = _weighed(entries)
    return plan.select(*keys, F.when(F.col("keep_doc_id").isNull(), "manual_review").otherwise("drop_duplicate_doc_ids").alias("action"), "keep_doc_id", "n_docs")


def cleanup_members(entries: DataFrame) -> DataFrame:
    """field, norm, doc_id and role (keep, drop or review) of the documents that the plan names."""
    counts, plan, keys = _weighed(entries)
    role = F.when(F.col("keep_doc_id").isNull(), "review").when(F.col("doc_id") == F.col("keep_doc_id"), "keep").otherwise("drop")
    return counts.join(plan, keys).select(*keys, "doc_id", role.alias("role"))


def canonical_ids(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested documents with the id under which their hash is known, else their own.

    ``requests`` has doc_id and source_sha256; ``existing`` also an ``ordinal``: the first
    entry of a hash decides.
    """
    known = existing.select(identity_text(F.col("source_sha256")).alias("h"), "doc_id", "ordinal").where("h is not null").groupBy("h").agg(F.min_by("doc_id", F.struct("ordinal", "doc_id")).alias("known"))
    r = requests.withColumn("h", identity_text(F.col("source_sha256")))
    return r.join(known, "h", "left").select("doc_id", F.coalesce("known", "doc_id").alias("canonical_doc_id"))


def taken(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates one of whose four keys another document already has: doc_id, field, existing_doc_id.

    The alternative of keys is one equi-join over (field, value), not a comparison of all
    pairs; of a field's matches the smallest document id is given.
    """
    with_id = lambda e: e.select("doc_id", F.col("doc_id").alias("document"), *FIELDS)

    def keys(e: DataFrame) -> DataFrame:
        each = F.array(F.struct(F.lit("doc_id").alias("field"), identity_text(F.col("document")).alias("norm")), *[F.struct(F.lit(f).alias("field"), normalized(f, F.col(f)).alias("norm")) for f in FIELDS])
        return with_id(e).select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*").where("norm is not null")

    have = keys(existing).groupBy("field", "norm").agg(F.min("doc_id").alias("existing_doc_id"))
    return keys(candidates).join(have, ["field", "norm"]).groupBy("doc_id", "field").agg(F.min("existing_doc_id").alias("existing_doc_id"))
