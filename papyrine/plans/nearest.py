"""Queries over vectors: search, filters, upserts, and the evaluation of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine import ports
from papyrine.functions import vectors as vx
from papyrine.operators import evaluation as ev
from papyrine.operators import reasoning, store
from papyrine.plans import sql as q
from papyrine.plans.content import current_chunks
from papyrine.sources.tables import load


def _one(spark: SparkSession, d: str) -> DataFrame:
    """The query of the single-query searches: the row of the smallest id."""
    e = load(spark, d, "embeddings")
    return e.orderBy("vec_id").limit(1)


def vec_topk(spark, d):
    """Ten nearest vectors of one."""
    return store.top_k(load(spark, d, "embeddings"), _one(spark, d), 10, "vec_id", "embedding")


def vec_topk_filtered(spark, d):
    """Nearest vectors among some labels and without others."""
    f = store.Filters(must=(store.Condition("label", (1, 2, 3, 4, 5, 6)),), must_not=(store.Condition("label", (3,)),))
    return store.top_k(load(spark, d, "embeddings"), _one(spark, d), 10, "vec_id", "embedding", f)


def vec_min_should(spark, d):
    """Nearest vectors that meet one of two optional conditions."""
    f = store.Filters(should=(store.Condition("label", (7,)), store.Condition("label", (8, 9))), least=1)
    return store.top_k(load(spark, d, "embeddings"), _one(spark, d), 10, "vec_id", "embedding", f)


def _batch(spark, d, k):
    e = load(spark, d, "embeddings")
    return store.top_k_batch(e, e.where("vec_id % 20 = 0"), k, "vec_id", "embedding")


def vec_topk_batch(spark, d):
    """Ten nearest vectors of each query (ids divisible by 20) among all."""
    return _batch(spark, d, 10)


def _results(spark, d, k):
    """Search results in the shape that evaluation reads; labels stand for documents."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("Doc"), F.col("label").cast("string")).alias("doc_id"), F.element_at(F.array(F.lit("Results"), F.lit("2. Methods"), F.lit("Notes")), (F.pmod("label", F.lit(3)) + 1).cast("int")).alias("header"))
    return _batch(spark, d, k).join(e, "id").select("query_id", "rank", "doc_id", "header", F.when(F.pmod("id", F.lit(3)) == 0, "Shown by others (Doe et al. 2001, doi:10/x)").otherwise("Shown here.").alias("content"), F.when(F.pmod("id", F.lit(2)) == 0, "table").otherwise("text").alias("chunk_type"))


def _expected(spark, d):
    e = load(spark, d, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.lit("").alias("doc_filter"), F.array(F.concat(F.lit("doc"), F.col("label").cast("string"))).alias("expected_docs"), F.array(F.lit("results")).alias("expected_headers"))


def summary(spark, d, k):
    """Summary of all searches with k results each."""
    return ev.retrieval_summary(ev.retrieval_metrics(_results(spark, d, k), _expected(spark, d)))


def eval_per_query(spark, d):
    """Metrics of each search."""
    return ev.retrieval_metrics(_results(spark, d, 5), _expected(spark, d)).drop("doc_filter")


def eval_summary(spark, d):
    """Summary of all searches."""
    return summary(spark, d, 5)


def eval_near_duplicates(spark, d):
    """How many of each search's results nearly repeat an earlier one."""
    g = _results(spark, d, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("r"))
    return g.select("query_id", ev.near_duplicates(F.transform("r", lambda x: x["content"])).alias("near_duplicates"))


def eval_regressions(spark, d):
    """Searches that are worse with ten results than with three."""
    x = _expected(spark, d)
    out = ev.regressions(ev.retrieval_metrics(_results(spark, d, 3), x), ev.retrieval_metrics(_results(spark, d, 10), x))
    return out.select("query_id", "issue", F.array_join("fields", ",").alias("fields"))


def eval_gate(spark, d):
    """Summary metrics of the two runs side by side."""
    return ev.metric_comparison(summary(spark, d, 3), summary(spark, d, 10))


def answer_confidence(spark, d):
    """Confidence of each search's answer from its citations."""
    g = _results(spark, d, 5).groupBy("query_id").agg(F.count("*").alias("citations"), F.count_distinct("doc_id").alias("docs"))
    return g.withColumn("confidence", ev.confidence(F.col("citations"), F.col("docs"), F.lit("")))


def answer_eval(spark, d):
    """Summary of the local model's answers to the evaluation questions."""
    from papyrine.operators import retrieval

    q = load(spark, d, "eval_passages").select("query_id", "query", "passage")
    results = retrieval.retrieve(q.select("query_id", "query"), current_chunks(spark, d))
    answers = reasoning.research(q.select("query_id", "query"), results)
    # What is expected comes from the answer passage, which the system never sees: the document nearest to it.
    asked = retrieval.plan_queries(q.select("query_id", F.col("passage").alias("query")))
    pool = retrieval.eligible(current_chunks(spark, d))
    nearest = retrieval.vector_candidates(asked, pool, k=1).join(pool.select("id", "doc_id"), "id").select("query_id", F.array("doc_id").alias("expected_doc_ids"))
    expected = q.select("query_id", F.lit(False).alias("expected_abstain"), F.lit("LOW").alias("expected_confidence_min")).join(nearest, "query_id", "left")
    return ev.answer_summary(ev.answer_metrics(answers, expected))


def answers(spark, d):
    """Answers of the evaluation questions by the local model."""
    from papyrine.operators import retrieval

    q = load(spark, d, "eval_passages").select("query_id", "query")
    return reasoning.research(q, retrieval.retrieve(q, current_chunks(spark, d)))


def point_ids(spark, d):
    """Version-5 ids of chunks."""
    return current_chunks(spark, d).where("id is not null").select("id", vx.uuid5(F.col("id")).alias("point_id"))


def embed_chunks(spark, d):
    """Vectors of current chunks by the local embedder."""
    e = current_chunks(spark, d).select("id", ports.embedder()(F.col("content")).alias("e"))
    return e.select("id", F.array_join(F.transform("e", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


def events_latest(spark, d):
    """The last event of each user, as an upsert leaves it."""
    return store.latest(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def events_upsert(spark, d):
    """A table of events after a batch replaced its users: clicks are the table, all else the batch."""
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    one = lambda x: store.latest(x, ["user_id"], ["ts", "event_id"])
    click = F.coalesce(F.col("event_type") == "click", F.lit(False))
    return store.upsert(one(e.where(click)), one(e.where(~click)), ["user_id"]).drop("ts")


QUERIES = {f.__name__: f for f in (vec_topk, vec_topk_filtered, vec_min_should, vec_topk_batch, eval_per_query, eval_summary, eval_near_duplicates, eval_regressions, eval_gate, answer_confidence, answer_eval, answers, point_ids, embed_chunks, events_latest, events_upsert)}

_COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


def _top(where: str) -> str:
    return f"select e.vec_id, e.label, {_COS} as score from embeddings e, (select * from embeddings order by vec_id limit 1) q where e.vec_id <> q.vec_id and {where} order by score desc, vec_id limit 10"


def _near(k: int) -> str:
    return f"select query_id, id, score, rank from (select q.vec_id as query_id, e.vec_id as id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) as rank from embeddings e, embeddings q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id) where rank <= {k}"


def _metrics(k: int) -> str:
    return f"""select query_id, count(*) as result_count, bool_or(d) as expected_doc_hit, bool_or(h) as expected_header_hit, bool_or(d and rank = 1) as top1_expected_doc_hit, bool_or(h and rank = 1) as top1_expected_header_hit,
      round_even(count_if(d) / count(*), 4) as doc_precision, round_even(count_if(h) / count(*), 4) as header_precision, count_if(id % 2 = 0) as table_hits, count_if(id % 3 = 0) as citation_noise_hits, count_if(label % 3 = 2) as non_structural_header_hits,
      count(distinct label) as distinct_doc_count, count(distinct label % 3) as distinct_header_count
      from (select n.*, e.label, e.label = q.label as d, e.label % 3 = 0 as h from ({_near(k)}) n join embeddings e on e.vec_id = n.id join embeddings q on q.vec_id = n.query_id) group by query_id"""


def _summary(k: int) -> str:
    r = lambda c: f"round_even(count_if({c}) / count(*), 4)"
    return f"""select count(*) as queries_total, {r('expected_doc_hit')} as expected_doc_hit_rate, {r('expected_header_hit')} as expected_header_hit_rate, {r('top1_expected_doc_hit')} as top1_expected_doc_hit_rate,
      {r('top1_expected_header_hit')} as top1_expected_header_hit_rate, round_even(avg(doc_precision), 4) as average_doc_precision, round_even(avg(header_precision), 4) as average_header_precision, count_if(citation_noise_hits > 0) as queries_with_citation_noise,
      count_if(table_hits > 0) as queries_with_table_hits, count_if(non_structural_header_hits > 0) as queries_with_non_structural_headers, count(*) as cross_document_queries, round_even(avg(doc_precision), 4) as cross_document_average_doc_precision,
      sum(table_hits)::bigint as total_table_hits, sum(citation_noise_hits)::bigint as total_citation_noise_hits from ({_metrics(k)})"""


_CHECK = {"lost": "a.{f} and not b.{f}", "lower": "b.{f} < a.{f}", "higher": "b.{f} > a.{f}"}
_FIELDS = ", ".join(f"case when {_CHECK[h].format(f=f)} then '{f}' end" for f, h in ev.REGRESSIONS.items())
_UNPIVOT = " union all ".join(f"select '{m}' as metric, a.{m}::double as baseline, b.{m}::double as candidate from a, b" for m in ev.SUMMARY_METRICS)

ORACLE = {
    "vec_topk": _top("true"),
    "vec_topk_filtered": _top("e.label in (1, 2, 3, 4, 5, 6) and e.label <> 3"),
    "vec_min_should": _top("(coalesce(e.label = 7, false)::int + coalesce(e.label in (8, 9), false)::int) >= 1"),
    "vec_topk_batch": _near(10),
    "eval_per_query": _metrics(5),
    "eval_summary": _summary(5),
    "eval_near_duplicates": f"select query_id, (count(*) - count(distinct id % 3 = 0))::int as near_duplicates from ({_near(5)}) group by query_id",
    "eval_regressions": f"select * from (select query_id, 'regressed' as issue, array_to_string(list_filter([{_FIELDS}], lambda x: x is not null), ',') as fields from ({_metrics(3)}) a join ({_metrics(10)}) b using (query_id)) where fields <> ''",
    "eval_gate": f"with a as ({_summary(3)}), b as ({_summary(10)}) select metric, baseline, candidate, round_even(candidate - baseline, 4) as delta, coalesce(round_even(candidate - baseline, 4) >= -0.02, false) as passed from ({_UNPIVOT})",
    "answer_confidence": f"select query_id, count(*) as citations, count(distinct label) as docs, case when count(*) >= 4 and count(distinct label) >= 2 then 'HIGH' when count(*) >= 2 then 'MEDIUM' else 'LOW' end as confidence from ({_near(5)}) n join embeddings e on e.vec_id = n.id group by query_id",
    "embed_chunks": f"select id, array_to_string({q.embedding("coalesce(content, '')")}, ',') as embedding from {q.CHUNKS}",
    "point_ids": f"""select id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + ('0x' || substr(h, 17, 1))::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
      from (select id, sha1(unhex('{vx.URL_NAMESPACE}') || encode(id)) as h from (select distinct id from chunks where id is not null))""",
    "events_latest": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc) as rn from events) where rn = 1",
    "events_upsert": """select user_id, event_id, event_type from (select user_id, event_id, event_type, row_number() over (partition by user_id order by coalesce(event_type = 'click', false), ts desc nulls last, event_id desc) as rn from events) where rn = 1""",
}
