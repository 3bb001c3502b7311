"""Retrieval: what a question asks for, which chunks may answer, their order and selection.

Rules are data: a family is a conjunction of clauses over substrings of the question, and
each family adds weights to kinds of sections. Candidates come from a search over vectors,
to which a question's conditions on roles, tables and document are given as filters; a
search by shared words stands beside it. Only the candidates of a question, of a fixed
number, are ordered and selected, and only theirs is content read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyrine import ports
from papyrine.functions import sections
from papyrine.functions import text as tx
from papyrine.functions.sections import any_of
from papyrine.operators import store
from papyrine.sources.tables import durable

# ---- fixed values: signals of questions
TABLE_SIGNALS = ("table", "compare", "comparison", "value", "values", "sensitivity", "specificity", "odds ratio", "ct-value", "ct value", "assay panel", "confirmation rate", "detection rate", "positivity rate", "confirmed by culture", "confirmed by pcr", "culture or pcr", "culture and/or pcr")
METRIC_SIGNALS = ("sensitivity", "specificity", "accuracy")
METADATA_SIGNALS = ("abstract", "summary", "overview")
#: Roles of chunks that never answer.
EXCLUDED_CONTENT, EXCLUDED_SECTION = ("reference", "front_matter"), ("references", "front_matter", "unknown")
#: Weights of section names found in a heading.
SECTION_WEIGHTS = (("document metadata/abstract", -3), ("conclusion", 4), ("result", 3), ("discussion", 3), ("abstract", -1), ("method", -1), ("introduction", -1))
CANDIDATES = 30
#: Chunks searched for a question: so many for each answer, so many at least; more where tables may answer.
SEARCHED, SEARCHED_TABLES = (8, 40), (12, 60)
#: Words that tell nothing of a table's subject, and patterns of a table of metrics: a metric and a quantity.
TABLE_STOP_WORDS = "which indexed paper papers study studies document documents contains contain table tabular results result data reported report findings finds obtained".split()
METRIC_WORDS = r"\b(?:sensitivity|specificity|accuracy|agreement|detection rate|false positive|false negative|ppv|npv|auc|roc|lod|limit of detection)\b"
METRIC_VALUES = r"\b\d+(?:\.\d+)?\s*%|\b\d+\.\d+\b|\b(?:positive predictive|negative predictive|ppv|npv|auc|roc|lod|limit of detection)\b"


@dataclass(frozen=True)
class Family:
    """A kind of question: every clause must hold; a clause holds when any of its signals is there.

    ``weights`` add to the score of chunks whose heading contains the section's name.
    """

    name: str
    clauses: tuple[tuple[str, ...], ...]
    none_of: tuple[str, ...] = ()
    weights: tuple[tuple[str, int], ...] = ()

    def column(self, question: Column) -> Column:
        q = F.lower(question)
        ok = F.lit(True)
        for c in self.clauses:
            ok = ok & any_of(q, c)
        return ok & ~any_of(q, self.none_of) if self.none_of else ok


#: General families; those of a field of study are to be given as data by its users.
FAMILIES: tuple[Family, ...] = (
    Family("outcome", (("performance", "sensitivity", "specificity", "findings", "result", "outcome", "data", "rate", "confirmation", "percentage", "proportion"),), (), (("result", 3), ("results", 3), ("conclusion", -2), ("discussion", -1))),
    Family("method", (("optimiz", "method", "experimental", "assay", "protocol"),), (), (("method", 4), ("methods", 4), ("result", 1), ("results", 1), ("conclusion", -2))),
    Family("comparison", (("compare", "comparing", "versus", " vs ", "with and without"),), (), (("result", 4), ("results", 4), ("discussion", -1))),
    Family("limits", (("limitation", "caveat", "implication", "conclusion", "usefulness", "limits"),), (), (("discussion", 3), ("conclusion", 3))),
    Family("review", (("review", "overview", "approaches", "arguments"),), (), (("introduction", 2), ("discussion", 2), ("summary", 2), ("abstract", 2), ("conclusion", -6))),
    Family("tables", (TABLE_SIGNALS,), (), (("result", 2), ("results", 2))),
)


def plan_queries(queries: DataFrame, text: str = "query", families: Sequence[Family] = FAMILIES) -> DataFrame:
    """What each question asks for: flags, table numbers, words, families and section weights."""
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    wants = any_of(q, ("table", "tabular"))
    hit = F.filter(F.array(*[F.when(f.column(F.col(text)), F.lit(f.name)) for f in families]), lambda x: x.isNotNull())
    return queries.withColumns(
        {
            "prefers_tables": any_of(q, TABLE_SIGNALS), "requires_tables": wants, "requires_metric_tables": wants & any_of(q, METRIC_SIGNALS),
            "prefers_metadata": any_of(q, METADATA_SIGNALS), "table_indices": tx.table_references(F.coalesce(F.col(text), F.lit(""))),
            "tokens": tx.query_tokens(F.coalesce(F.col(text), F.lit(""))), "families": hit,
        }
    )


def eligible(chunks: DataFrame) -> DataFrame:
    """Chunks that may answer any question: no references, front matter or boilerplate.

    ``chunks`` has content, content_role, section_role, is_low_value; a missing field
    excludes nothing. The conditions reach the scan.
    """
    keep = ~F.coalesce(F.col("content_role").isin(*EXCLUDED_CONTENT), F.lit(False)) & ~F.coalesce(F.col("section_role").isin(*EXCLUDED_SECTION), F.lit(False)) & ~F.coalesce(F.col("is_low_value"), F.lit(False))
    return chunks.where(keep).where(~tx.is_low_value(F.col("content")))


def lexical_candidates(planned: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k chunks of each question that share most of its words (then by id): query_id, id, shared, place.

    Chunks' words are joined with the questions' words only; the pairs are counted where
    they arise, and a word that a third of all chunks have is counted by partial sums.
    """
    words = chunks.select("id", F.explode(tx.token_set(F.col("content"), 3)).alias("t"))
    asked = planned.select("query_id", F.explode("tokens").alias("t"))
    pairs = words.join(asked, "t").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    w = W.partitionBy("query_id").orderBy(F.desc("shared"), "id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _is_table() -> Column:
    return F.coalesce(F.col("content_role") == "table", F.lit(False))


def searched(planned: DataFrame, chunks: DataFrame, limit: int = 5, k: int | None = None) -> DataFrame:
    """As ``lexical_candidates``, of the chunks whose role each question admits.

    Tables are admitted where a question prefers them, and nothing else where it requires
    tables of metrics; where it requires tables, a chunk is a table or names one (one of those
    asked for, if any). These conditions come before the places are given, so that no place goes
    to a chunk that is dropped. ``k`` is the number of places, by kind of question where None.
    """
    refs = F.coalesce(F.col("referenced_table_indices"), F.array().cast("array<int>")) if "referenced_table_indices" in chunks.columns else F.array().cast("array<int>")
    words = chunks.select("id", _is_table().alias("table"), refs.alias("refs"), F.explode(tx.token_set(F.col("content"), 3)).alias("t"))
    most, bound = places(planned, limit, k)
    asked = planned.select("query_id", "prefers_tables", "requires_tables", "requires_metric_tables", "table_indices", most.alias("most"), F.explode("tokens").alias("t"))
    named = F.when(F.size("table_indices") > 0, F.arrays_overlap("refs", "table_indices")).otherwise(F.size("refs") > 0)
    admitted = F.when(F.col("table"), F.col("prefers_tables")).otherwise(~F.col("requires_metric_tables") & (~F.col("requires_tables") | named))
    pairs = words.join(asked, "t").where(admitted).groupBy("query_id", "id").agg(F.count("*").alias("shared"), F.first("most").alias("most"))
    w = W.partitionBy("query_id").orderBy(F.desc("shared"), "id")
    # The fixed bound lets tasks keep so many rows first.
    return pairs.withColumn("place", F.row_number().over(w)).where((F.col("place") <= bound) & (F.col("place") <= F.col("most"))).drop("most")


def places(planned: DataFrame, limit: int, k: int | None) -> tuple[Column, int]:
    """Places of a question by its kind, and the bound that none of these numbers passes."""
    tables, plain = max(limit * SEARCHED_TABLES[0], SEARCHED_TABLES[1]), max(limit * SEARCHED[0], SEARCHED[1])
    return (F.when(F.col("prefers_tables"), tables).otherwise(plain), max(tables, plain)) if k is None else (F.lit(k), k)


def _admitted(q: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    """Which chunks of a block each question of another may find (see ``vector_candidates``)."""
    table, refs = t["table"].to_numpy(bool), [set(r) for r in t["refs"]]
    named = np.array([bool(r) for r in refs], bool)
    docs = t["doc"].to_numpy()
    out = np.zeros((len(q), len(t)), bool)
    for i, r in enumerate(q.itertuples(index=False)):
        asked = set(r.table_indices)
        own = named if not asked else np.array([bool(x & asked) for x in refs], bool)
        text = np.zeros(len(t), bool) if r.requires_metric_tables else own if r.requires_tables else np.ones(len(t), bool)
        out[i] = np.where(table, r.prefers_tables, text) & (True if not r.doc else docs == r.doc)
    return out


def vector_candidates(planned: DataFrame, chunks: DataFrame, limit: int = 5, k: int | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The nearest chunks of each question, by cosine, then id: query_id, id, score, place.

    Tables are admitted where a question prefers them, and nothing else where it requires
    tables of metrics; where it requires tables, a chunk is a table or names one (one of those
    asked for, if any); where it names a document (``doc_filter``), the chunk is of that one.
    These conditions hold before the places are given. Questions and chunks without a known
    word find nothing and aren't found.
    """
    embed = embed or ports.embedder()
    most, bound = places(planned, limit, k)
    none = F.array().cast("array<int>")
    refs = F.coalesce(F.col("referenced_table_indices"), none) if "referenced_table_indices" in chunks.columns else none
    doc = lambda c: F.coalesce(tx.collapse(F.lower(c)), F.lit(""))
    asked = F.col("doc_filter") if "doc_filter" in planned.columns else F.lit("")
    t = chunks.where("id is not null").select("id", _is_table().alias("table"), refs.alias("refs"), doc("doc_id").alias("doc"), embed(F.col("content")).alias("v"))
    q = planned.select("query_id", "prefers_tables", "requires_tables", "requires_metric_tables", "table_indices", doc(asked).alias("doc"), embed(F.col("query")).alias("v"))
    found = store.top_k_batch(t, q, bound, "id", "v", False, _admitted, ("prefers_tables", "requires_tables", "requires_metric_tables", "table_indices", "doc"), ("table", "refs", "doc"), "query_id")
    return found.join(planned.select("query_id", most.alias("most")), "query_id").where("rank <= most").select("query_id", "id", "score", F.col("rank").alias("place"))


def returned(candidates: DataFrame) -> DataFrame:
    """Candidates whose content is what is shown of them, without markup.

    Of a child that knows its paragraph, its sentences with one more at each side; of a table,
    its caption where the text lacks it, up to two linked contexts, and its text; else the
    content. The columns parent_content, sentence_start, sentence_end, table_caption and
    linked_contexts are used where they are there.
    """
    have = set(candidates.columns)
    body = F.coalesce(F.col("parent_content"), F.col("content")) if "parent_content" in have else F.col("content")
    shown = F.col("content")
    if {"parent_content", "sentence_start", "sentence_end"} <= have:
        child = (F.col("content_role") == "child") & F.col("sentence_start").isNotNull() & F.col("parent_content").isNotNull()
        shown = F.when(child, context_window(tx.sentences(F.col("parent_content")), F.col("sentence_start"), F.col("sentence_end"))).otherwise(shown)
    parts = []
    if "table_caption" in have:
        caption = tx.clean_markdown(F.coalesce("table_caption", F.lit("")))
        parts.append(F.when((caption != "") & ~F.lower(tx.clean_markdown(body)).contains(F.lower(caption)), F.concat(F.lit("Table Caption: "), caption)))
    if "linked_contexts" in have:
        linked = F.filter(F.transform(F.coalesce("linked_contexts", F.array().cast("array<string>")), tx.clean_markdown), lambda x: x != "")
        parts.append(F.when(F.size(linked) > 0, F.concat(F.lit("Linked Context: "), F.array_join(F.slice(linked, 1, 2), " "))))
    table = F.array_join(F.filter(F.array(*parts, body), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")
    return candidates.withColumn("content", tx.clean_markdown(F.when(_is_table(), table).otherwise(shown)))


def fitting(candidates: DataFrame) -> DataFrame:
    """Searched chunks that fit what their question asks of tables.

    Text that is a written-out table is dropped where no table is preferred, text that names
    tables where tables are required and too few of the question's words are there, and tables
    without metrics where those are required.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    bars = F.length(content) - F.length(F.replace(content, F.lit("|"), F.lit("")))
    rows = F.size(F.filter(F.split(content, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    embedded = (bars >= 6) & (content.rlike(r"\|\s*-{3,}") | (rows >= 3))
    subject = F.array_except("tokens", F.array(*map(F.lit, TABLE_STOP_WORDS)))
    shared = F.size(F.array_intersect(subject, tx.token_set(content, 3)))
    linked = (F.size("table_indices") > 0) | (shared >= F.least(F.lit(3), F.size(subject)))
    text = F.lower(tx.clean_markdown(F.concat_ws(" ", content, F.coalesce(F.col("parent_header"), F.lit("")))))
    metric = text.rlike(METRIC_WORDS) & text.rlike(METRIC_VALUES)
    fits = F.when(_is_table(), ~F.col("requires_metric_tables") | metric).otherwise((F.col("prefers_tables") | ~embedded) & (~F.col("requires_tables") | linked))
    return candidates.where(fits)


def priority(candidates: DataFrame, families: Sequence[Family] = FAMILIES) -> DataFrame:
    """Adds header_bonus, word_bonus and role_bonus, by which candidates are ordered.

    ``candidates`` joins planned questions with their chunks: families, tokens,
    prefers_tables, parent_header, content, content_role, doc_id.
    """
    head = F.lower(tx.clean_markdown(F.coalesce("parent_header", F.lit(""))))
    bonus = F.lit(0)
    for name, weight in SECTION_WEIGHTS:
        bonus = bonus + F.when(head.contains(name), weight).otherwise(0)
    for f in families:
        own = F.lit(0)
        for name, weight in f.weights:
            own = own + F.when(head.contains(name), weight).otherwise(0)
        bonus = bonus + F.when(F.array_contains("families", f.name), own).otherwise(0)
    body = F.lower(tx.clean_markdown(F.coalesce("content", F.lit(""))))
    title = F.lower(F.translate(F.coalesce("doc_id", F.lit("")), "-_", "  "))
    within = lambda text: F.size(F.filter("tokens", lambda t: F.contains(text, t)))
    lexical = F.least(F.lit(4), within(body)) + F.least(F.lit(3), within(head) * 2) + F.least(F.lit(2), within(title))
    is_table = F.coalesce(F.col("content_role") == "table", F.lit(False))
    wants = F.col("prefers_tables")
    role = F.when(is_table & wants, 8).when(is_table, -3).when(wants, -1).otherwise(0) + F.when(F.col("content_role") == "child", 1).otherwise(0)
    role = role + F.when(head.contains("document metadata/abstract"), 0).otherwise(1)
    return candidates.withColumns({"header_bonus": bonus, "word_bonus": lexical, "role_bonus": role})


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their place by bonuses, then by the place they came in; abstracts only
    where a question asks for them or nothing else is there."""
    w = W.partitionBy("query_id")
    meta = sections.is_metadata_like(F.col("parent_header"))
    c = candidates.withColumn("_body", F.max((~meta).cast("int")).over(w)).where(F.col("prefers_metadata") | ~meta | (F.col("_body") == 0)).drop("_body")
    order = w.orderBy(F.desc("header_bonus"), F.desc("word_bonus"), F.desc("role_bonus"), "place")
    return c.withColumn("position", F.row_number().over(order))


def _select(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Greedy choice among one question's candidates: new parents, no near repeats, spread."""
    import re

    chosen, parents, kept, heads, docs, bodies = [], set(), [], {}, {}, set()
    for r in pdf.sort_values("position").itertuples():
        parent, head, doc = r.parent_id or r.id, " ".join((r.parent_header or "unknown").lower().split()), " ".join((r.doc_id or "").split()).lower()
        content = r.content or ""
        if parent in parents or len(content) < tx.LEAST_CONTENT_CHARS:
            continue
        # An abstract says nothing more of a document whose body answers already.
        if r.meta and doc in bodies and not r.prefers_metadata and not r.doc_filter:
            continue
        words = {t for t in re.findall(r"[a-z0-9]+", content.lower()) if len(t) > 2}
        if words and any(len(words & k) / max(1, min(len(words), len(k))) > tx.NEAR_DUPLICATE_OVERLAP for k in kept if k):
            continue
        most_head = 2 if any(t in head for t in ("discussion", "result", "conclusion")) else 1
        most_doc = limit if r.doc_filter else 1 if limit <= 3 or len(chosen) < 3 else min(2, limit)
        if heads.get((doc, head), 0) >= most_head or docs.get(doc, 0) >= most_doc:
            continue
        chosen.append(r.Index)
        parents.add(parent)
        kept.append(words)
        heads[doc, head] = heads.get((doc, head), 0) + 1
        docs[doc] = docs.get(doc, 0) + 1
        if not r.meta:
            bodies.add(doc)
        if len(chosen) == limit:
            break
    out = pdf.loc[chosen, ["query_id", "id", "doc_id", "parent_header", "content", "chunk_type"]].copy()
    out["rank"] = range(1, len(out) + 1)
    return out.astype({"rank": "int64"})


def select(ordered: DataFrame, limit: int = 5) -> DataFrame:
    """The answers of each question: at most ``limit``, diverse, in order.

    A group is one question's candidates, whose number is fixed, so no group grows with
    the data.
    """
    kind = ordered.schema["query_id"].dataType.simpleString()
    asked = F.col("doc_filter") if "doc_filter" in ordered.columns else F.lit("")
    abstracts = F.col("prefers_metadata") if "prefers_metadata" in ordered.columns else F.lit(False).alias("prefers_metadata")
    cols = ["query_id", "id", "doc_id", "parent_id", "parent_header", "content", "chunk_type", "position", abstracts, F.coalesce(asked, F.lit("")).alias("doc_filter"), sections.is_metadata_like(F.col("parent_header")).alias("meta")]
    schema = f"query_id {kind}, id string, doc_id string, parent_header string, content string, chunk_type string, rank long"
    return ordered.select(*cols).groupBy("query_id").applyInPandas(lambda pdf: _select(pdf, limit), schema)


def retrieve(queries: DataFrame, chunks: DataFrame, limit: int = 5, k: int | None = None, families: Sequence[Family] = FAMILIES, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers of each question from the chunks nearest to it: query_id, rank, id, doc_id, …

    Chunks need id, content, doc_id, parent_header, chunk_type, parent_id, content_role,
    section_role, is_low_value, and may have referenced_table_indices and the columns that
    ``returned`` uses; ids must be unique (current rows only). A question may name its
    document in ``doc_filter``.
    """
    return stages(queries, chunks, limit, k, families, embed)["final"]


def stages(queries: DataFrame, chunks: DataFrame, limit: int = 5, k: int | None = None, families: Sequence[Family] = FAMILIES, embed: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """The candidates after each stage, for explanation. The found places are stored, so that
    the search runs once; content is read again for them alone."""
    planned = plan_queries(queries, families=families)
    pool = eligible(chunks)
    found = durable(vector_candidates(planned, pool, limit, k, embed), "found")
    full = fitting(pool.join(found, "id").join(planned, "query_id"))
    order = ranked(priority(full, families))
    return {"planned": planned, "initial": found, "ranked": order, "final": select(returned(order), limit)}


def context_window(parent_sentences: Column, start: Column, end: Column) -> Column:
    """A child's sentences with one more at each side."""
    low = F.greatest(F.lit(0), start - 1)
    return F.array_join(F.slice(parent_sentences, low + 1, F.greatest(F.least(F.size(parent_sentences), end + 1) - low, F.lit(0))), " ")
