import json

from papyrine import ports
from papyrine.operators import catalog
from papyrine.operators.chunking import chunk_documents
from papyrine.sources import artifacts, sinks
from papyrine.streaming import ingest


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a b.md").write_text("# T\n\ntext")
    (tmp_path / "a.table_01.csv").write_text("x,y\n1,2")
    (tmp_path / "a.table_01.json").write_text('[{"x": 1}]')
    assert [r.markdown_text for r in artifacts.markdown_files(spark, str(tmp_path)).collect()] == ["# T\n\ntext"]
    t = artifacts.table_artifacts(spark, str(tmp_path)).collect()
    assert [(r.doc_stem, r.table_index, r.csv, r.json) for r in t] == [("a", 1, "x,y\n1,2", '[{"x": 1}]')]
    files = artifacts.binary_files(spark, str(tmp_path), "*.md")
    got = ports.parse_files(files, lambda content, path: content.decode()).collect()
    assert got[0].error is None and got[0].markdown_text.startswith("# T")
    bad = ports.parse_files(files, lambda content, path: 1 / 0).collect()
    assert bad[0].markdown_text is None and "zero" in bad[0].error


def test_manifest_and_registry(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"collection": "c", "parser": "p", "docs": [{"doc_id": "a", "chunk_count": 2}, {"doc_id": "b", "parser": "q"}]}))
    m = {r.doc_id: r for r in artifacts.manifest_file(spark, str(tmp_path / "m.json")).collect()}
    assert (m["a"].parser, m["b"].parser, m["a"].chunk_count) == ("p", "q", 2)
    (tmp_path / "r.json").write_text(json.dumps({"collections": {"c": {"docs": {"a": {"chunk_count": 1}}}, "old": {"z": {"chunk_count": 3}, "manifest_path": "x"}}}))
    r = {(x.collection, x.doc_key): x.chunk_count for x in artifacts.registry_file(spark, str(tmp_path / "r.json")).collect()}
    assert r == {("c", "a"): 1, ("old", "z"): 3}


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "Q1", "query": "x", "expected_docs": [" a ", " "]}]))
    assert artifacts.evaluation_queries(spark, str(tmp_path / "q.json")).first().expected_docs == ["a"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("i", "d", "text", "h", 1, "c", "role", [1.0, 2.0], ["a", "b"])], "id string, doc_id string, chunk_type string, parent_header string, page_number int, content string, role string, v array<float>, tags array<string>")
    r = sinks.export_records(df, vector="v").first()
    assert json.loads(r.payload) == {"role": "role", "tags": ["a", "b"]} and json.loads(r.vector) == [1.0, 2.0]
    sinks.write_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "o")).first().tags == "a | b"


def test_stream_replaces_chunks(spark, tmp_path):
    schema = "doc_id string, markdown_text string, tables array<struct<headers:array<string>,rows:array<map<string,string>>,csv:string>>"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for text in ("First words of it.", "Second words of it."):
        spark.createDataFrame([("d", text, None)], schema).write.mode("append").parquet(src)
        ingest.stream_chunks(spark, src, schema, out, cp).awaitTermination(120)
    assert [r.content for r in ingest.current(spark, out).collect()] == ["Second words of it."]


def test_versions_and_replacement(spark):
    m = spark.createDataFrame([("c", "a", "ingestion_v1", None, "chunking_v2"), ("c", "b", " ", "chunking_v1", "chunking_v2")], "collection string, doc_id string, ingestion_version string, chunker_version string, chunking_version string")
    assert {r.doc_id: r.issues for r in catalog.version_issues(m, "ingestion_v2", "chunking_v2").collect()} == {"a": ["ingestion_version"], "b": ["chunker_version"]}
    t = spark.createDataFrame([("D 1", "x"), ("e", "y")], "doc_id string, v string")
    assert sorted(r.v for r in catalog.replace_document(t, "d  1", spark.createDataFrame([("D 1", "z")], t.schema)).collect()) == ["y", "z"]


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    v = [r[0] for r in df.select(ports.embedder()(df.t)).collect()]
    assert v[0] == v[1] and len(v[2]) == ports.DIMENSIONS and not any(v[2])


def test_rerank_keeps_order_of_ties(spark):
    df = spark.createDataFrame([("q", "x", "c1", 2), ("q", "x", "c2", 1), ("q", "x", "long content", 3)], "query_id string, query string, content string, place int")
    out = ports.rerank(df, lambda q, c: c.str.len().astype(float), 3).orderBy("rank").collect()
    assert [r.content for r in out] == ["long content", "c2", "c1"]


def test_chunking_repeats_rows(spark):
    df = spark.createDataFrame([("d", "a b c."), ("d", "a b c.")], "doc_id string, markdown_text string")
    assert chunk_documents(df, tables_col=None).count() == 2
