"""From retrieved chunks to answers: guards, prompt, parsing, confidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import strip
from papyrine.operators.evaluation import confidence
from papyrine.operators.retrieval import Family

INSUFFICIENT = "Insufficient evidence.\n\nThe retrieved context does not state the values that the question asks for."
PROMPT = "Answer only from the context below. Name the document of every statement. If the context does not answer the question, say: Insufficient evidence.\n\nContext:\n{context}\n\nQuestion: {question}\n\nReply in two parts:\n1. Research Insight\n2. Evidence Basis"
QUANTITY = r"\b\d+(?:\.\d+)?\s*%|\b\d+\s*/\s*\d+\b"
#: Questions that text alone can't answer; families of a field of study are given as data.
GAPS: tuple[Family, ...] = (Family("figure", (("figure",), ("what does", "distribution", "correlate", "correlation", "look like"))),)


def forced_abstention(question: Column, contents: Column, gaps: Sequence[Family] = GAPS, interventions: Sequence[str] = ()) -> Column:
    """Whether an answer is withheld before any model is asked.

    Either a gap family matches, or the question wants values before and after a named
    intervention and no retrieved content has a quantity with that name.
    """
    out = F.lit(False)
    for g in gaps:
        out = out | g.column(question)
    q = F.lower(question)
    wants = q.contains("before and after") & (q.contains("detection rate") | q.contains("sensitivity") | q.contains("specificity"))
    if interventions:
        named, stated = F.lit(False), F.lit(False)
        for m in interventions:
            named = named | q.contains(m)
            stated = stated | (q.contains(m) & F.exists(contents, lambda c: F.lower(c).contains(m) & F.lower(c).rlike(QUANTITY)))
        out = out | (wants & named & ~stated)
    return F.coalesce(out, F.lit(False))


def evidence(results: DataFrame) -> DataFrame:
    """Per question: context text, evidence lines of distinct sources in order, counts.

    ``results`` are at most a few ranked rows per question (query_id, rank, doc_id,
    parent_header, content).
    """
    row = F.struct("rank", "doc_id", "parent_header", "content")
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    line = lambda x: F.concat(F.lit("Source: "), F.coalesce(x["parent_header"], F.lit("")), F.lit(" | Document: "), F.coalesce(x["doc_id"], F.lit("")), F.lit("\n"), F.coalesce(x["content"], F.lit("")))
    bullet = lambda x: F.concat(F.lit("- "), F.coalesce(x["doc_id"], F.lit("")), F.lit(", "), F.coalesce(x["parent_header"], F.lit("")))
    return g.select(
        "query_id", F.array_join(F.transform("r", line), "\n\n").alias("context"), F.array_join(F.array_distinct(F.transform("r", bullet)), "\n").alias("evidence_lines"),
        F.size("r").alias("citation_count"), F.size(F.array_distinct(F.transform("r", lambda x: x["doc_id"]))).alias("cited_docs"), F.transform("r", lambda x: x["content"]).alias("contents"),
    )


def prompt(question: Column, context: Column) -> Column:
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def parse_reply(reply: Column) -> tuple[Column, Column]:
    """Insight and evidence basis of a two-part reply; a reply without parts is all insight."""
    head = r"(?is)(?:1\.\s*)?Research Insight[^\n]*\n(.*?)(?=(?:2\.\s*)?Evidence Basis|\z)"
    tail = r"(?is)(?:2\.\s*)?Evidence Basis[^\n]*\n(.*)"
    insight = F.when(F.regexp_like(reply, F.lit(head)), F.regexp_extract(reply, head, 1)).otherwise(reply)
    return strip(insight), strip(F.regexp_extract(reply, tail, 1))


def extract(contexts):
    """Local stand-in of a language model: the first sentence of each source, as two parts."""
    import pandas as pd

    def reply(c: str) -> str:
        parts = [p.split("\n", 1) for p in (c or "").split("\n\n") if p.startswith("Source: ")]
        if not parts:
            return INSUFFICIENT
        said = " ".join(p[1].split(". ")[0].strip() for p in parts if len(p) > 1)
        return f"1. Research Insight\n{said}\n2. Evidence Basis\n" + "\n".join(p[0] for p in parts)

    return pd.Series([reply(c) for c in contexts])


def research(queries: DataFrame, results: DataFrame, model: Callable = extract, gaps: Sequence[Family] = GAPS, interventions: Sequence[str] = ()) -> DataFrame:
    """query_id, insight, evidence_basis, confidence, citation_count, abstained of each question.

    Questions that are withheld never reach the model: the branches are separate plans.
    """
    e = queries.select("query_id", "query").join(evidence(results), "query_id", "left")
    e = e.withColumns({"citation_count": F.coalesce("citation_count", F.lit(0)), "cited_docs": F.coalesce("cited_docs", F.lit(0)), "contents": F.coalesce("contents", F.array().cast("array<string>"))})
    e = e.withColumn("withheld", forced_abstention(F.coalesce("query", F.lit("")), F.col("contents"), gaps, interventions) | (F.col("citation_count") == 0))
    held = e.where("withheld").select("query_id", F.lit(INSUFFICIENT).alias("insight"), F.coalesce("evidence_lines", F.lit("")).alias("evidence_basis"), "citation_count", "cited_docs")
    ask = F.pandas_udf(model, "string")
    said = e.where("not withheld").withColumn("reply", ask(F.col("context")))
    insight, basis = parse_reply(F.col("reply"))
    told = said.select("query_id", insight.alias("insight"), basis.alias("evidence_basis"), "citation_count", "cited_docs")
    both = held.unionByName(told)
    return both.withColumn("confidence", confidence(F.col("citation_count"), F.col("cited_docs"), F.col("insight"))).drop("cited_docs")
