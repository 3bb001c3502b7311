"""Column functions and folds against plain Python on small fixtures."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import markdown as md
from papyrine.functions import sections, tables, vectors
from papyrine.functions import text as tx
from papyrine.functions.folding import folded
from papyrine.operators import chunking as ck
from papyrine.operators import evaluation as ev
from papyrine.operators import reasoning, retrieval, store


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_folded(spark):
    assert column(spark, [" A  b\n", "", "  ", None, "ß"], folded) == ["a b", None, None, None, "ß"]


def test_clean_markdown(spark):
    got = column(spark, ["a<br/>b *c* `d`\n\n\n\ne x@y.org ![i](u) [t](#page-3) <b> </b>", None, ""], tx.clean_markdown)
    assert got == ["a\nb c d\n\ne   t", None, ""]


def test_citations(spark):
    assert column(spark, ["x [1] y [2, 3-5] [a]", None], tx.strip_citations) == ["x y [a]", None]


SENT = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def test_sentences_and_windows(spark):
    texts = ["", None, "One.", "A b. C d! 3 e? f. G", "x.  Y.\nZ. 1. 2", "  "]
    want = [[s for s in SENT.split(re.sub(r"\s+", " ", t or "").strip()) if s] for t in texts]
    assert column(spark, texts, tx.sentences) == want
    got = column(spark, texts, lambda c: tx.sentence_windows(tx.sentences(c)))
    for s, w in zip(want, got):
        starts = [0] if len(s) <= 2 else list(range(len(s) - 1))
        assert [(x.start, x.end, x.content) for x in w] == [(k, min(k + 2, len(s)), " ".join(s[k : k + 2])) for k in starts]


def test_token_overlap_at_the_limit(spark):
    df = spark.createDataFrame([("aaa bbb ccc", "aaa bbb zzz yyy"), ("", "aaa"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(tx.overlap(tx.token_set(F.col("a")), tx.token_set(F.col("b")))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0]


def test_page_and_tables(spark):
    assert column(spark, ["see Page 7, table 3 and Table 1, table 3", "", "page 99999999999"], tx.page_number) == [7, None, None]
    assert column(spark, ["see Page 7, table 3 and Table 1, table 3", ""], tx.table_references) == [[1, 3], []]


def test_low_value(spark):
    assert column(spark, ["short", "Copyright of the authors, all funding is stated here.", "A sentence that is long enough to count.", None], tx.is_low_value) == [True, True, False, True]


def test_identity_paths(spark):
    assert column(spark, ["Data\\In//./A.pdf", "./x/", " ", None], tx.identity_path) == ["data/in/a.pdf", "x", None, None]
    assert column(spark, ["a\\b\\My  File.v2.pdf", "x/.hidden", "plain"], tx.doc_id_from_path) == ["My File.v2", ".hidden", "plain"]


def test_pipe_tables(spark):
    text = "before | one\n| a |  | a |\n|---|:---:|---|\n| 1 | 2 |\n| 3 | 4 | 5 | 6 |\nafter\n\n| x |\n|---|\n| y |"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(md.table_runs(F.col("t")).alias("r"))
    runs = [r.r for r in df.collect()]
    assert [len(r) for r in runs] == [1, 0, 0]
    one = df.where(F.size("r") > 0).select(md.unique_headers(md.table_headers(F.col("r")[0])).alias("h"), md.table_rows(F.col("r")[0]).alias("d"), md.quoted_csv(F.array(F.lit('q"')), F.array(F.array(F.lit("a,b")))).alias("c")).first()
    assert one.h == ["a", "column_2", "a (2)"] and one.d == [["1", "2", ""], ["3", "4", "5"]] and one.c == '"q"""\n"a,b"'


def test_title_rows(spark):
    m = [["Title", None, None, None], ["Note", None, None, None], ["Name", "n", "Value", "p"], ["a", "1", "2", "3"], ["b", "4", "5", "6"]]
    no_header = [["1", "2"], ["3", "4"]]
    got = column(spark, [m, no_header, []], tables.trim_titles, "array<array<string>>")
    assert (got[0].trimmed, got[0].titles[0][0], len(got[0].rows)) == (2, "Title", 3)
    assert (got[1].trimmed, len(got[1].rows)) == (0, 2) and got[2].rows == []


def test_sections(spark):
    heads = ["3.1 Materials and Methods", "RESULTS | Discussion", "Funding", None, "", "Unknown", "Smith vol 3", "What we saw in the wards"]
    assert column(spark, heads, sections.section_role) == ["body", "body", "front_matter", "unknown", "unknown", "unknown", "body", "body"]
    assert column(spark, heads, sections.canonical_sections) == [["methods"], ["results", "discussion"], [], [], [], [], [], []]
    assert column(spark, heads, sections.header_kind)[3:] == ["opening_metadata", "opening_metadata", "subsection", "citation_like", "title_like"]


def test_cosine_and_ids(spark):
    import uuid

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), None, None]
    names = ["doc:P00001:C01", "", "é"]
    assert column(spark, names, vectors.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=12), st.integers(3, 20), st.integers(0, 2))
def test_packing(sizes, limit, overlap):
    p = ["x" * n for n in sizes]
    runs = ck.pack(p, limit, overlap)
    covered = set()
    for a, b in runs:
        assert b > a and (b - a == 1 or len("\n\n".join(p[a:b])) <= limit)
        covered |= set(range(a, b))
    assert covered == set(range(len(p)))
    assert all(x[0] < y[0] for x, y in zip(runs, runs[1:]))


def test_headings_fold():
    text = "# A title of the paper here\n\nintro\n\n## Background\n\nb1\n\n### Samples\n\nb2\n\n## What we saw in all the wards\n\nc1\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nc2"
    got = [(k, n, s, role, c.split("\n")[0]) for k, n, s, _, role, c in ck.fold(text, ["a,b\n1,2", "extra"], 900, 1)]
    assert got == [
        ("text", 1, sections.OPENING_HEADER, "title_like", "intro"), ("text", 2, "Background", "structural", "b1"), ("text", 3, "Background", "subsection", "b2"),
        ("text", 4, "Background", "thematic_structural", "c1"), ("table", 1, "Background", "thematic_structural", "a,b"), ("table", 2, "Background", "thematic_structural", "extra"), ("text", 5, "Background", "thematic_structural", "c2"),
    ]


def test_chunks_of_nothing(spark):
    df = spark.createDataFrame([("d", None, None), (None, "", None)], "doc_id string, markdown_text string, tables array<struct<headers:array<string>,rows:array<map<string,string>>,csv:string>>")
    assert ck.chunk_documents(df).count() == 0
    assert ck.chunk_documents(df.limit(0)).count() == 0


def test_table_links(spark):
    text = "## Results\n\nTable 1 lists the sodium levels of all patients. Other words follow here.\n\nSodium levels differed between patients treated early.\n\n| sodium | levels | patients |\n|---|---|---|\n| 1 | 2 | 3 |"
    df = spark.createDataFrame([("d", text)], "doc_id string, markdown_text string")
    links = ck.table_links(ck.chunks(ck.parents(df, overlap=0, limit=90))).collect()
    assert len(links) == 1 and links[0].contexts == ["Table 1 lists the sodium levels of all patients."]


def test_filters_on_missing_fields_and_arrays(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None), (3, "b", [3])], "i int, k string, t array<int>")
    ids = lambda f: sorted(r.i for r in df.where(f.column(df)).collect())
    c = store.Condition
    assert ids(store.Filters(must_not=(c("k", ("a",)),))) == [2, 3]
    assert ids(store.Filters(must=(c("t", (2, 3)),))) == [1, 3]
    assert ids(store.Filters(should=(c("k", ("a", "b")), c("t", (3,))), least=2)) == [3]
    with pytest.raises(ValueError):
        df.where(store.Filters(must=(c("k"),)).column(df))


def test_top_k_batch_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(store, "QUERY_BLOCK", 2)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0]) for _ in range(3)]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>")
    got = {(r.query_id, r.rank): (r.id, round(r.score, 6)) for r in store.top_k_batch(df, df.where("i < 5"), 4, "i", "v").collect()}

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else None

    want = {}
    for q, v in rows[:5]:
        s = [(-cos(v, w), j) for j, w in rows[:42] if w and j != q and cos(v, w) is not None]
        for k, (x, j) in enumerate(sorted(s)[:4]):
            want[q, k + 1] = (j, -x)
    assert got == want


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, store.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, store.upsert(a.limit(0), b.limit(0), ["k"]).collect())) == []


def test_metrics_without_results_or_expectations(spark):
    q = spark.createDataFrame([("a", "", ["D"], ["Results"]), ("b", "x", [], [])], "query_id string, doc_filter string, expected_docs array<string>, expected_headers array<string>")
    none = spark.createDataFrame([], "query_id string, rank int, doc_id string, header string, content string, chunk_type string")
    got = {r.query_id: r for r in ev.retrieval_metrics(none, q).collect()}
    assert (got["a"].expected_doc_hit, got["a"].doc_precision, got["b"].expected_doc_hit, got["b"].doc_precision) == (False, 0.0, True, None)
    one = spark.createDataFrame([("a", 1, "d", "2. results", "x", "table"), ("a", 2, "e", "Notes", "[1] [2]", "text")], none.schema)
    r = {x.query_id: x for x in ev.retrieval_metrics(one, q).collect()}["a"]
    assert (r.doc_precision, r.header_precision, r.table_hits, r.citation_noise_hits, r.non_structural_header_hits, r.top1_expected_header_hit) == (0.5, 0.5, 1, 1, 1, True)
    s = ev.retrieval_summary(ev.retrieval_metrics(none, q.limit(0))).first()
    assert (s.queries_total, s.expected_doc_hit_rate, s.average_doc_precision) == (0, 0.0, None)


def test_answers(spark):
    q = spark.createDataFrame([("a", "What does figure 2 show in its distribution?"), ("b", "Is sodium low?"), ("c", "Nothing known")], "query_id string, query string")
    res = spark.createDataFrame([("a", 1, "d", "Results", "text of d"), ("b", 1, "d", "Results", "Sodium is low. More."), ("b", 2, "e", "Notes", "Also e.")], "query_id string, rank long, doc_id string, parent_header string, content string")
    got = {r.query_id: r for r in reasoning.research(q, res).collect()}
    assert (got["a"].confidence, got["b"].confidence, got["c"].confidence) == ("INSUFFICIENT", "MEDIUM", "INSUFFICIENT")
    assert got["b"].insight == "Sodium is low Also e." and got["a"].evidence_basis == "- d, Results"
    parts = spark.createDataFrame([("1. Research Insight: x\nAll good.\n2. Evidence Basis\n- d",), ("no parts",)], "r string")
    i, e = reasoning.parse_reply(F.col("r"))
    assert [tuple(r) for r in parts.select(i, e).collect()] == [("All good.", "- d"), ("no parts", "")]


def test_selection_spreads_and_drops_repeats(spark):
    text = "sodium levels were measured in every ward of the hospital"
    rows = [("q", f"c{i}", f"d{i % 3}", f"p{i}", "Results", text + f" {w}", "text", i + 1) for i, w in enumerate(["", "", "alpha beta gamma delta epsilon zeta", "", "one two three four five six seven", "x"])]
    df = spark.createDataFrame(rows, "query_id string, id string, doc_id string, parent_id string, parent_header string, content string, chunk_type string, position int")
    got = [r.id for r in retrieval.select(df, 5).orderBy("rank").collect()]
    assert got[0] == "c0" and "c3" not in got and len(got) == len(set(got))


def test_roles_are_asked_for_before_places_are_given(spark):
    body = "potassium levels were measured in every ward of the hospital"
    schema = "id string, content string, doc_id string, parent_header string, chunk_type string, parent_id string, content_role string, section_role string, is_low_value boolean, referenced_table_indices array<int>"
    chunk = lambda i, text, role, refs=None: (i, text, f"d{i}", "Results", role, i, role, "body", False, refs)
    rows = [chunk(f"a{n:03}", f"{body} | {n}", "table") for n in range(80)]
    rows += [chunk("t1", f"{body} and of clinics one", "text"), chunk("t2", "the potassium levels named in table 2 were measured there", "text", [2]), chunk("t3", "the potassium levels named in table 3 were measured there", "text", [3])]
    rows += [chunk("z1", "potassium levels and sensitivity of the assay | 91.5 % | 88.1 %", "table")]
    chunks = spark.createDataFrame(rows, schema)
    asked = {"text": "were potassium levels measured in every ward hospital", "two": "which potassium levels of table 2 were measured", "metric": "which table has potassium levels with sensitivity"}
    q = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    got: dict = {}
    for r in retrieval.retrieve(q, chunks).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert "t1" in got["text"] and not any(i[0] in "az" for i in got["text"])
    assert got["metric"] == {"z1"}
    first = {k: {r.id for r in retrieval.searched(retrieval.plan_queries(q), chunks).where(F.col("query_id") == k).collect()} for k in asked}
    assert len(first["two"]) == 60 and not first["two"] & {"t1", "t3"} and first["text"] == {"t1", "t2", "t3"}
