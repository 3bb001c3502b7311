"""Gates that a collection passes before it is promoted, and the report over them.

Each gate is one row: gate, status (pass, review_required or fail) and issues. The inputs
are summaries, so nothing here grows with the data; a missing input fails its gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.evaluation import metric_comparison

# ---- fixed values: bounds of the gate over answers
LEAST_ABSTAIN_ACCURACY, MOST_ABSTAIN_DROP, LEAST_INSIGHT_RATE, LEAST_CONFIDENCE_RATE, MOST_FALSE_CONFIDENCE = 0.8, 0.1, 1.0, 0.75, 0
MOST_METRIC_DROP = 0.02


def _gate(name: str, one: DataFrame, issues: list[Column], review: Column | None = None) -> DataFrame:
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    status = F.when(F.size("issues") > 0, "fail").when(review if review is not None else F.lit(False), "review_required").otherwise("pass")
    return one.withColumn("issues", found).select(F.lit(name).alias("gate"), status.alias("status"), "issues")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Single-row frames side by side; each has exactly one row by aggregation."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f))
    return out


def rebuild_gate(manifest: DataFrame, failed: DataFrame, collection: str, target_docs: int = 0) -> DataFrame:
    """A rebuilt collection: its manifest is there, complete and its own, and no file failed."""
    m = manifest.agg(F.count("*").alias("docs"), F.count_if(~F.col("collection").eqNullSafe(F.lit(collection))).alias("foreign"))
    f = failed.agg(F.count("*").alias("failed"))
    d = F.col("docs")
    issues = [
        F.when(d == 0, F.lit("missing_manifest")),
        F.when(F.col("foreign") > 0, F.lit("collection_mismatch")),
        F.when((d > 0) & (F.lit(target_docs) > 0) & (d != target_docs), F.concat(F.lit("document_count:"), d.cast("string"))),
        F.when(F.col("failed") > 0, F.concat(F.lit("failed_files:"), F.col("failed").cast("string"))),
    ]
    return _gate("rebuild", _one_row(m, f), issues)


def audit_gate(issues: DataFrame, cleanup: DataFrame, versions: DataFrame) -> DataFrame:
    """The audit of a collection: no issue, nothing to clean up, no other versions."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    told = lambda name: F.when(F.col(name) > 0, F.concat(F.lit(f"{name}:"), F.col(name).cast("string")))
    return _gate("audit", _one_row(n(versions, "version_issues"), n(issues, "reconciliation_issues"), n(cleanup, "cleanup_entries")), [told("version_issues"), told("reconciliation_issues"), told("cleanup_entries")])


def audit_fails(gate: DataFrame) -> bool:
    """Whether an audit is to end with a failure."""
    return gate.where("status = 'fail'").count() > 0


def eval_gate(name: str, candidate: DataFrame, baseline: DataFrame | None, most_drop: float = MOST_METRIC_DROP) -> DataFrame:
    """An evaluation against its baseline: no metric missing or lower by more than the drop allowed.

    Without a baseline the metrics are to be reviewed.
    """
    if baseline is None:
        return _gate(name, candidate.agg(F.count("*").alias("n")), [F.when(F.col("n") == 0, F.lit("missing_report"))], F.lit(True))
    m = metric_comparison(baseline, candidate, most_drop)
    issue = F.concat(F.when(F.col("delta").isNull(), F.lit("missing:")).otherwise(F.lit("dropped:")), F.col("metric"))
    one = m.agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), issue))).alias("issues"))
    return one.select(F.lit(name).alias("gate"), F.when(F.size("issues") > 0, "fail").otherwise("pass").alias("status"), "issues")


def spot_check_gate(checks: DataFrame) -> DataFrame:
    """Checks by hand (query, status): there are some, and none failed."""
    c = checks.agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim("status")) == "fail").alias("failed"))
    return _gate("manual_spot_check", c, [F.when(F.col("n") == 0, F.lit("no_checks")), F.when(F.col("failed") > 0, F.concat(F.lit("failed_checks:"), F.col("failed").cast("string")))])


def synthesis_checks(baseline: DataFrame, current: DataFrame, known_gaps: DataFrame) -> DataFrame:
    """check, baseline, current, delta, passed of answers against their baseline.

    ``baseline`` and ``current`` are one-row summaries (abstain_accuracy, has_insight_rate,
    confidence_meets_minimum_rate); ``known_gaps`` has the confidence of answers to questions
    that can't be answered, none of which may be HIGH.
    """
    names = ("abstain_accuracy", "has_insight_rate", "confidence_meets_minimum_rate")
    b = baseline.select(*[F.col(c).cast("double").alias(f"b_{c}") for c in names])
    c = current.select(*[F.col(x).cast("double").alias(f"c_{x}") for x in names])
    g = known_gaps.agg(F.count_if(F.upper(F.trim("confidence")) == "HIGH").cast("double").alias("false_confidence"))
    delta = lambda x: F.bround(F.col(f"c_{x}") - F.col(f"b_{x}"), 4)
    none = F.lit(None).cast("double")

    def row(name: str, base: Column, now: Column, change: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), base.alias("baseline"), now.alias("current"), change.alias("delta"), F.coalesce(passed, F.lit(False)).alias("passed"))

    a, i, k = names
    each = F.array(
        row(a, F.col(f"b_{a}"), F.col(f"c_{a}"), delta(a), (F.col(f"c_{a}") >= LEAST_ABSTAIN_ACCURACY) & (delta(a) >= -MOST_ABSTAIN_DROP)),
        row(i, none, F.col(f"c_{i}"), none, F.col(f"c_{i}") >= LEAST_INSIGHT_RATE),
        row(k, F.col(f"b_{k}"), F.col(f"c_{k}"), delta(k), F.col(f"c_{k}") >= LEAST_CONFIDENCE_RATE),
        row("false_confidence_on_known_gaps", none, F.col("false_confidence"), none, F.col("false_confidence") <= MOST_FALSE_CONFIDENCE),
    )
    return _one_row(b, c, g).select(F.explode(each).alias("x")).select("x.*")


def synthesis_gate(checks: DataFrame) -> DataFrame:
    """The gate over ``synthesis_checks``."""
    one = checks.agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("issues"))
    return one.select(F.lit("synthesis").alias("gate"), F.when(F.size("issues") > 0, "fail").otherwise("pass").alias("status"), "issues")


def report(gates: list[DataFrame]) -> DataFrame:
    """All gates and, as the gate ``overall``, their status: fail, review_required or pass, in that order of weight."""
    every = gates[0]
    for g in gates[1:]:
        every = every.unionByName(g)
    most = every.agg(F.count_if(F.col("status") == "fail").alias("f"), F.count_if(F.col("status") == "review_required").alias("r"), F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.col("gate")))).alias("issues"))
    return every.unionByName(most.select(F.lit("overall").alias("gate"), F.when(F.col("f") > 0, "fail").when(F.col("r") > 0, "review_required").otherwise("pass").alias("status"), "issues"))


def may_promote(rows: DataFrame, alias: str) -> bool:
    """Whether a report allows its collection to be promoted to a named alias."""
    return bool(alias.strip()) and rows.where("gate = 'overall' and status = 'pass'").count() == 1
