"""Evaluation of retrieval and of answers, and gates over the summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import sections
from papyrine.functions import text as tx

CONFIDENCE = ("INSUFFICIENT", "LOW", "MEDIUM", "HIGH")
#: Metrics compared between runs, fixed values.
SUMMARY_METRICS = ("expected_doc_hit_rate", "expected_header_hit_rate", "top1_expected_doc_hit_rate", "top1_expected_header_hit_rate", "average_doc_precision", "average_header_precision", "cross_document_average_doc_precision")


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, 0 where b is 0."""
    return F.when(b > 0, F.bround(a / b, 4)).otherwise(F.lit(0.0))


def retrieval_metrics(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: hits, top-1 hits, precisions and noise counts.

    ``results`` has query_id, rank, doc_id, header, content, chunk_type; ``queries`` has
    query_id, doc_filter, expected_docs, expected_headers (arrays). Without expectations a
    hit is true and a precision null; without results hits fail and precisions are 0.
    """
    e = queries.select("query_id", "doc_filter", F.transform(F.coalesce("expected_docs", F.array()), F.lower).alias("docs"), F.coalesce("expected_headers", F.array().cast("array<string>")).alias("headers"))
    r = e.join(results, "query_id", "left")
    there = F.col("rank").isNotNull()
    d = there & F.array_contains("docs", F.lower("doc_id"))
    h = there & sections.header_matches(F.col("header"), F.col("headers"))
    r = r.select(
        "query_id", "doc_filter", F.size("docs").alias("nd"), F.size("headers").alias("nh"), there.alias("there"), F.coalesce(d, F.lit(False)).alias("d"), F.coalesce(h, F.lit(False)).alias("h"),
        (F.col("rank") == 1).alias("top"), (there & (F.lower("chunk_type") == "table")).alias("table"), (there & tx.is_citation_heavy(F.col("content"))).alias("noise"),
        (there & sections.is_non_structural(F.col("header"))).alias("loose"), F.lower("doc_id").alias("doc"), tx.collapse(F.lower("header")).alias("head"),
    )
    g = r.groupBy("query_id").agg(
        F.first("doc_filter").alias("doc_filter"), F.max("nd").alias("nd"), F.max("nh").alias("nh"), F.count_if("there").alias("result_count"),
        F.count_if("d").alias("docs_right"), F.count_if("h").alias("headers_right"), F.count_if(F.col("top") & F.col("d")).alias("top_d"), F.count_if(F.col("top") & F.col("h")).alias("top_h"),
        F.count_if("table").alias("table_hits"), F.count_if("noise").alias("citation_noise_hits"), F.count_if("loose").alias("non_structural_header_hits"),
        F.count_distinct(F.nullif("doc", F.lit(""))).alias("distinct_doc_count"), F.count_distinct(F.nullif("head", F.lit(""))).alias("distinct_header_count"),
    )
    return g.select(
        "query_id", "doc_filter", "result_count",
        ((F.col("nd") == 0) | (F.col("docs_right") > 0)).alias("expected_doc_hit"), ((F.col("nh") == 0) | (F.col("headers_right") > 0)).alias("expected_header_hit"),
        ((F.col("nd") == 0) | (F.col("top_d") > 0)).alias("top1_expected_doc_hit"), ((F.col("nh") == 0) | (F.col("top_h") > 0)).alias("top1_expected_header_hit"),
        F.when(F.col("nd") > 0, ratio(F.col("docs_right"), F.col("result_count"))).alias("doc_precision"), F.when(F.col("nh") > 0, ratio(F.col("headers_right"), F.col("result_count"))).alias("header_precision"),
        "table_hits", "citation_noise_hits", "non_structural_header_hits", "distinct_doc_count", "distinct_header_count",
    )


def near_duplicates(contents: Column) -> Column:
    """How many of a result's contents nearly repeat an earlier one that doesn't itself.

    ``contents`` is one question's few results in order; contents without words don't count.
    """
    sets = F.filter(F.transform(contents, lambda c: tx.token_set(c)), lambda t: F.size(t) > 0)
    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        again = F.exists(acc["kept"], lambda k: tx.overlap(t, k) > tx.NEAR_DUPLICATE_OVERLAP)
        return F.struct(F.when(again, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(t))).alias("kept"), (acc["n"] + again.cast("int")).alias("n"))

    return F.aggregate(sets, start, step, lambda acc: acc["n"])


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """One row of rates and totals; rates of no queries are 0, averages null."""
    n = F.count("*")
    rate = lambda c: ratio(F.count_if(c), n)
    cross = F.coalesce(F.col("doc_filter"), F.lit("")) == ""
    return metrics.agg(
        n.alias("queries_total"), rate("expected_doc_hit").alias("expected_doc_hit_rate"), rate("expected_header_hit").alias("expected_header_hit_rate"),
        rate("top1_expected_doc_hit").alias("top1_expected_doc_hit_rate"), rate("top1_expected_header_hit").alias("top1_expected_header_hit_rate"),
        F.bround(F.avg("doc_precision"), 4).alias("average_doc_precision"), F.bround(F.avg("header_precision"), 4).alias("average_header_precision"),
        F.count_if(F.col("citation_noise_hits") > 0).alias("queries_with_citation_noise"), F.count_if(F.col("table_hits") > 0).alias("queries_with_table_hits"),
        F.count_if(F.col("non_structural_header_hits") > 0).alias("queries_with_non_structural_headers"), F.count_if(cross).alias("cross_document_queries"),
        F.bround(F.avg(F.when(cross, F.col("doc_precision"))), 4).alias("cross_document_average_doc_precision"),
        F.coalesce(F.sum("table_hits"), F.lit(0)).alias("total_table_hits"), F.coalesce(F.sum("citation_noise_hits"), F.lit(0)).alias("total_citation_noise_hits"),
    )


def confidence(n_citations: Column, n_docs: Column, insight: Column) -> Column:
    """Confidence from the number of citations and documents; none where the text abstains."""
    none = (n_citations == 0) | F.lower(F.coalesce(insight, F.lit(""))).contains("insufficient evidence")
    return F.when(none, "INSUFFICIENT").when((n_citations >= 4) & (n_docs >= 2), "HIGH").when(n_citations >= 2, "MEDIUM").otherwise("LOW")


def confidence_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)


def answer_metrics(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: abstention right or not, confidence against its minimum, coverage.

    ``answers`` has query_id, insight, evidence_basis, confidence, citation_count;
    ``queries`` has query_id, expected_abstain, expected_confidence_min (or null),
    expected_doc_ids (array).
    """
    j = queries.join(answers, "query_id")
    abstained = F.lower(F.coalesce("insight", F.lit(""))).contains("insufficient evidence")
    basis = match_text(F.coalesce("evidence_basis", F.lit("")))
    ids = F.coalesce("expected_doc_ids", F.array().cast("array<string>"))
    found = F.size(F.filter(ids, lambda d: basis.contains(match_text(d))))
    return j.select(
        "query_id", abstained.alias("abstained"), (abstained == F.col("expected_abstain")).alias("abstain_correct"),
        (F.trim(F.coalesce("insight", F.lit(""))) != "").alias("has_insight"), (F.trim(F.coalesce("evidence_basis", F.lit(""))) != "").alias("has_evidence_basis"), "confidence",
        F.when(F.col("expected_confidence_min").isNotNull(), confidence_order(F.col("confidence")) >= confidence_order(F.col("expected_confidence_min"))).alias("confidence_meets_minimum"),
        F.when(F.size(ids) > 0, F.bround(found / F.size(ids), 4)).alias("doc_id_coverage"), "citation_count",
    )


def answer_summary(metrics: DataFrame) -> DataFrame:
    n = F.count("*")
    checked = F.count("confidence_meets_minimum")
    return metrics.agg(
        n.alias("queries_total"), ratio(F.count_if("abstain_correct"), n).alias("abstain_accuracy"), ratio(F.count_if("has_insight"), n).alias("has_insight_rate"),
        ratio(F.count_if("has_evidence_basis"), n).alias("has_evidence_basis_rate"), F.when(checked > 0, ratio(F.count_if("confidence_meets_minimum"), checked)).alias("confidence_meets_minimum_rate"),
        F.bround(F.avg("doc_id_coverage"), 4).alias("average_doc_id_coverage"), F.bround(F.avg("citation_count"), 4).alias("average_citation_count"),
    )


def match_text(c: Column) -> Column:
    """Text as document ids are looked for in it: lower case, one kind of dash, no emphasis."""
    x = F.regexp_replace(F.lower(c), "[‐‑‒–—−]+", "-")
    return tx.collapse(F.regexp_replace(x, r"[*_`]+", ""))


def metric_comparison(baseline: DataFrame, candidate: DataFrame, max_drop: float = 0.02, metrics: tuple[str, ...] = SUMMARY_METRICS) -> DataFrame:
    """metric, baseline, candidate, delta, passed of two one-row summaries; missing values don't pass."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("e")).select("e.*")
    j = long(baseline, "baseline").join(long(candidate, "candidate"), "metric", "full_outer")
    delta = F.bround(F.col("candidate") - F.col("baseline"), 4)
    return j.select("metric", "baseline", "candidate", delta.alias("delta"), F.coalesce(delta >= -max_drop, F.lit(False)).alias("passed"))


REGRESSIONS = {"expected_doc_hit": "lost", "expected_header_hit": "lost", "top1_expected_doc_hit": "lost", "top1_expected_header_hit": "lost", "doc_precision": "lower", "header_precision": "lower", "table_hits": "lower", "citation_noise_hits": "higher"}


def regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Queries missing from a run, or worse in it: query_id, issue, fields.

    Nulls count as 0 or false, so that a null precision is compared, not a failure.
    """
    a, b = baseline.alias("a"), candidate.alias("b")
    j = a.join(b, F.col("a.query_id") == F.col("b.query_id"), "full_outer")
    checks = []
    for f, how in REGRESSIONS.items():
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        if how == "lost":
            bad = F.coalesce(x, F.lit(False)) & ~F.coalesce(y, F.lit(False))
        else:
            x, y = F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))
            bad = y < x if how == "lower" else y > x
        checks.append(F.when(bad, F.lit(f)))
    missing = F.col("a.query_id").isNull() | F.col("b.query_id").isNull()
    fields = F.when(missing, F.array().cast("array<string>")).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    out = j.select(F.coalesce("a.query_id", "b.query_id").alias("query_id"), F.when(missing, "missing_query").otherwise("regressed").alias("issue"), fields.alias("fields"))
    return out.where((F.col("issue") == "missing_query") | (F.size("fields") > 0))
