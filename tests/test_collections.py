"""Registry, replacement, gates, comparison within collections, search with conditions, lifetimes."""

import os

import pytest
from pyspark.sql import functions as F

from papyrine.functions import layout, tables
from papyrine.operators import catalog, evaluation, identity, reconcile, retrieval, rollout, store
from papyrine.sources import tables as files
from papyrine.streaming import ingest

MANIFEST = "collection string, doc_id string, source_file string, local_file string, source_sha256 string, chunk_count int, text_chunk_count int, table_chunk_count int, parser string, ingestion_version string, chunker_version string, chunking_version string, file_size_bytes long"


def manifest(spark, *rows):
    return spark.createDataFrame([(c, d, f"{d}.pdf", f"/x/{d}.pdf", h, n, n, 0, None, " v ", None, "k2", None) for c, d, h, n in rows], MANIFEST)


def test_replacing_keeps_rows_without_document(spark):
    t = spark.createDataFrame([("A", "1"), (None, "2"), ("B", "3"), (" b", "4")], "doc_id string, v string")
    fresh = spark.createDataFrame([("B", "9")], t.schema)
    assert sorted(r.v for r in catalog.replace_document(t, "b", fresh).collect()) == ["1", "2", "9"]
    kept = catalog.document_rows(t, "B")
    assert sorted(r.v for r in catalog.restore_document(catalog.replace_document(t, "B", fresh), "B", kept).collect()) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        catalog.replace_document(t, "B", fresh.limit(0))


def test_registry_from_manifest(spark):
    m = manifest(spark, ("c", "a", "H", 3), ("c", " ", "x", 1), ("d", "a", None, None))
    r = {(x.collection, x.doc_id): x for x in catalog.registry_from_manifest(m).collect()}
    assert set(r) == {("c", "a"), ("d", "a")} and r["c", "a"].chunks == 3 and r["c", "a"].chunker_version == "k2" and r["c", "a"].ingestion_version == "v"
    assert r["d", "a"].source_sha256 == "" and r["d", "a"].chunks == 0 and r["c", "a"].parser == ""
    assert {x.collection: (x.doc_count, x.chunk_count) for x in catalog.registry_totals(catalog.registry_from_manifest(m)).collect()} == {"c": (1, 3), "d": (1, 0)}


def test_registry_refuses_what_another_document_has(spark):
    have = catalog.registry_from_manifest(manifest(spark, ("c", "a", "h1", 1), ("c", "b", "h2", 1)))
    new = catalog.registry_from_manifest(manifest(spark, ("c", "z", "H1 ", 1), ("d", "y", "h1", 1), ("c", "b", "h2", 7)))
    assert [(r.doc_id, r.field, r.existing_doc_id) for r in catalog.refused_entries(have, new).collect()] == [("z", "source_sha256", "a")]
    with pytest.raises(ValueError):
        catalog.upsert_registry(have, new)
    ok = catalog.upsert_registry(have, new.where("doc_id <> 'z'"))
    assert sorted((r.collection, r.doc_id, r.chunks) for r in ok.collect()) == [("c", "a", 1), ("c", "b", 7), ("d", "y", 1)]
    assert {r.collection for r in catalog.alias_entries(ok, "live").collect()} == {"live"}
    assert catalog.canonical_doc_id(have, "q", " H2") == "b" and catalog.canonical_doc_id(have, "q", "none") == "q"


def test_gates_and_report(spark):
    m, none = manifest(spark, ("c", "a", "h", 1)), spark.createDataFrame([], "doc_id string, path string, error string")
    status = lambda g: (g.first().status, list(g.first().issues))
    assert status(rollout.rebuild_gate(m, none, "c", 1)) == ("pass", [])
    assert status(rollout.rebuild_gate(m, none, "d", 2)) == ("fail", ["collection_mismatch", "document_count:1"])
    assert status(rollout.rebuild_gate(m.limit(0), none, "c")) == ("fail", ["missing_manifest"])
    assert status(rollout.audit_gate(none, m, none)) == ("fail", ["cleanup_entries:1"])
    metrics = lambda x: spark.createDataFrame([tuple([x] * len(evaluation.SUMMARY_METRICS))], ", ".join(f"{c} double" for c in evaluation.SUMMARY_METRICS))
    assert status(rollout.eval_gate("e", metrics(0.9), metrics(0.91)))[0] == "pass"
    bad = status(rollout.eval_gate("e", metrics(0.8), metrics(0.9).withColumn("average_doc_precision", F.lit(None).cast("double"))))
    assert bad[0] == "fail" and "missing:average_doc_precision" in bad[1] and "dropped:expected_doc_hit_rate" in bad[1]
    assert status(rollout.eval_gate("e", metrics(0.9), None))[0] == "review_required"
    checks = lambda *s: rollout.spot_check_gate(spark.createDataFrame([("q", x) for x in s], "query string, status string"))
    assert [status(checks(*s))[0] for s in ((), ("pass", "Fail "), ("pass",))] == ["fail", "fail", "pass"]
    summary = lambda a, i, c: spark.createDataFrame([(a, i, c)], "abstain_accuracy double, has_insight_rate double, confidence_meets_minimum_rate double")
    gaps = spark.createDataFrame([("LOW",), (None,)], "confidence string")
    assert status(rollout.synthesis_gate(rollout.synthesis_checks(summary(0.9, 1.0, 0.8), summary(0.85, 1.0, 0.75), gaps))) == ("pass", [])
    worse = rollout.synthesis_checks(summary(0.95, 1.0, 0.8), summary(0.84, 0.99, None), gaps.unionAll(spark.createDataFrame([(" high",)], "confidence string")))
    assert status(rollout.synthesis_gate(worse))[1] == ["abstain_accuracy", "confidence_meets_minimum_rate", "false_confidence_on_known_gaps", "has_insight_rate"]
    report = rollout.report([rollout.rebuild_gate(m, none, "c"), rollout.eval_gate("e", metrics(0.9), None)])
    assert [(r.gate, r.status) for r in report.where("gate = 'overall'").collect()] == [("overall", "review_required")]
    assert not rollout.may_promote(report, "x") and rollout.may_promote(rollout.report([rollout.rebuild_gate(m, none, "c")]), "x")


def test_near_duplicates(spark):
    df = spark.createDataFrame([(["alpha beta gamma", "ALPHA beta, gamma", "delta", "", None, "delta epsilon", "zeta eta theta"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(evaluation.near_duplicates(F.col("c"))).collect()] == [2, 0]


def test_identities_within_collections(spark):
    rows = [("c", "m", "a", "H", None, None), ("c", "m", "b", " h", None, None), ("d", "m", "e", "h", None, None), ("c", "r", "a", "h", None, None), ("c", "m", "x", None, "f", None), ("c", "r", "y", None, "F", None)]
    e = spark.createDataFrame(rows, "collection string, source string, doc_id string, source_sha256 string, source_file string, local_file string")
    assert [(r.collection, r.source, r.norm, r.n_docs, r.first_doc_id) for r in identity.duplicates(e).collect()] == [("c", "m", "h", 2, "a")]
    assert sorted(r.doc_id for r in identity.duplicate_members(e).collect()) == ["a", "b"]
    plan = {r.norm: (r.action, r.keep_doc_id, r.n_docs) for r in identity.cleanup_plan(e).collect()}
    assert plan == {"h": ("drop_duplicate_doc_ids", "a", 2), "f": ("manual_review", None, 2)}
    assert {(r.norm, r.doc_id): r.role for r in identity.cleanup_members(e).collect()} == {("h", "a"): "keep", ("h", "b"): "drop", ("f", "x"): "review", ("f", "y"): "review"}


def test_sides_are_compared_within_collections(spark):
    side = lambda *r: spark.createDataFrame([(c, d, n, n, 0) for c, d, n in r], "collection string, doc_id string, chunks int, text_chunks int, table_chunks int")
    both = reconcile.three_way(side(("c", "a", 1), ("d", "a", 1)), side(("c", "a", 1), ("d", "a", 2)), side(("c", "a", 1)))
    assert [(r.collection, r.doc_id, r.issue_type, list(r.present_in)) for r in reconcile.presence_issues(both).collect()] == [("d", "a", "missing_doc", ["store", "manifest"])]


def test_stream_leaves_no_stale_chunks(spark, tmp_path):
    schema = "doc_id string, markdown_text string, tables array<struct<headers:array<string>,rows:array<map<string,string>>,csv:string>>"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for doc, text in (("d", "One goes. Two goes. Three goes. Four goes."), ("e", "Other words stay."), ("d", "Only one."), ("e", None)):
        spark.createDataFrame([(doc, text, None)], schema).write.mode("append").parquet(src)
        ingest.stream_chunks(spark, src, schema, out, cp, buckets=4).awaitTermination(120)
        if text == "Only one.":
            assert sorted(r.content for r in ingest.current(spark, out).collect()) == ["Only one.", "Other words stay."]
    assert [r.content for r in ingest.current(spark, out).collect()] == ["Only one."]


def test_batch_search_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0] * 5), (903, [0.0] * 6)]
    t = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    monkeypatch.setattr(store, "TABLE_BLOCK", 40)
    monkeypatch.setattr(store, "QUERY_BLOCK", 7)
    got = {}
    for r in store.top_k_batch(t, t.where("id % 20 = 0"), 5, "id", "v").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    n = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    for q in range(0, 300, 20):
        s = np.round(n @ n[q], 6) + 0.0
        order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q and x[i].any()][:5]
        assert [i for _, i, _ in sorted(got.get(q, []))] == (order if x[q].any() else [])
    assert store.top_k_batch(t.limit(0), t, 5, "id", "v").count() == 0 and store.top_k_batch(t, t.limit(0), 5, "id", "v").count() == 0


def chunks(spark):
    rows = [
        ("t1", "sensitivity of the assay was 91.2 % in table form", "d1", "Results", "table", None, "table"), ("x1", "the assay has a sensitivity as table 2 shows in results", "d1", "Results", "child", [2], "text"),
        ("x2", "the assay has a sensitivity that was fine in all cases", "d2", "Discussion", "child", None, "text"), ("m2", "the assay abstract says sensitivity was fine in most cases", "d2", "Abstract", "child", None, "text"),
        ("r", "references of the assay sensitivity et al. doi:10 and more", "d3", "References", "reference", None, "text"),
    ]
    return spark.createDataFrame([(i, c, d, h, r, x, k, i, "body", False) for i, c, d, h, r, x, k in rows], "id string, content string, doc_id string, parent_header string, content_role string, referenced_table_indices array<int>, chunk_type string, parent_id string, section_role string, is_low_value boolean")


def test_conditions_hold_before_places_are_given(spark):
    q = spark.createDataFrame([("plain", "How was the assay overall?", None), ("table", "Which table shows assay sensitivity?", None), ("two", "What does table 2 say of the assay?", None), ("doc", "How was the assay overall?", " D2")], "query_id string, query string, doc_filter string")
    got = {}
    for r in retrieval.vector_candidates(retrieval.plan_queries(q), retrieval.eligible(chunks(spark))).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {"plain": {"x1", "x2", "m2"}, "table": {"t1"}, "two": {"t1", "x1"}, "doc": {"x2", "m2"}}
    answers = retrieval.retrieve(q, chunks(spark)).collect()
    assert {r.id for r in answers if r.query_id == "doc"} == {"x2"}


def test_what_is_shown(spark):
    df = spark.createDataFrame(
        [("child", "B two.", "A one. B two. C three. D four.", 1, 2, None, None), ("table", "t", "x,y", None, None, "*Rates*", ["see **it**", "", "b", "c"]), ("table", "t", "x,rates", None, None, "Rates", None), ("note", "as it is", None, None, None, None, None)],
        "content_role string, content string, parent_content string, sentence_start int, sentence_end int, table_caption string, linked_contexts array<string>",
    )
    assert [r.content for r in retrieval.returned(df).collect()] == ["A one. B two. C three.", "Table Caption: Rates\n\nLinked Context: see it b\n\nx,y", "x,rates", "as it is"]


def test_cells(spark):
    df = spark.createDataFrame([('a,"b, ""c""\nd",e\n1,,3',), ("",)], "t string")
    assert [r[0] for r in df.select(tables.csv_cells(F.col("t"))).collect()] == [[["a", 'b, "c"\nd', "e"], ["1", "", "3"]], [[""]]]
    line = spark.createDataFrame([("  ab c   12  x",), (None,)], "t string")
    assert [[tuple(x) for x in r[0]] for r in line.select(layout.segments(F.col("t"))).collect()] == [[(2, "ab c"), (9, "12"), (13, "x")], []]
    # Each cell reaches half-way to its neighbours' anchors, wherever words end.
    assert line.select(layout.cells_at(F.lit("ab   12  x y"), F.array(F.lit(0), F.lit(5), F.lit(9)))).first()[0] == ["ab", "12", "x y"]
    assert line.select(layout.cells_at(F.lit("ab"), F.array(F.lit(0), F.lit(5), F.lit(9)))).first()[0] == ["ab", "", ""]


def test_intermediates_end_with_their_use(spark):
    files.release(spark)
    root = files.scratch_dir(spark).removeprefix("file:")
    a = files.durable(spark.range(10), "one")
    b = files.durable(a.selectExpr("id % 2 as k", "id"), "two", by="k")
    assert b.where("k = 1").count() == 5 and len(os.listdir(root)) == 2
    files.discard(a)
    assert len(os.listdir(root)) == 1
    files.release(spark)
    assert not os.path.exists(root)


def test_clusters_need_a_shared_folder(spark):
    class Other:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://x:7077"

    with pytest.raises(RuntimeError):
        files.shared_dir(Other)
