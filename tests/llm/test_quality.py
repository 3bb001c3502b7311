import numpy as np
import pytest

from papyrine.llm import quality as q


@pytest.fixture(scope="module")
def learned(spark):
    return q.learn(spark)


def test_held_out_accuracy(spark, learned):
    made = q.labelled(150, seed=123)
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(made)], "doc_id long, text string, kind string")
    got = {r.doc_id: r.kind for r in q.classified(df, learned[0]).select("doc_id", "kind").collect()}
    right = np.mean([got[i] == k.split(".")[0] for i, (_, k) in enumerate(made)])
    assert right > 0.94


def test_rules_are_few_and_in_order(learned):
    kinds = [k for _, k in learned[1]]
    assert kinds == sorted(kinds, key=["junk", "table", "list"].index) and 3 <= len(kinds) <= 40
    assert all(1 <= len(r) <= 5 for r, _ in learned[1])


def test_plain_cases(spark, learned):
    texts = {
        "prose": "The samples were kept at room temperature for a week, and the values of the control group did not change. It was not possible to repeat the test.",
        "list": "Reagents\n- sodium chloride\n- ethanol\n- acetone\n- water, distilled\n- agar (5)",
        "table": "Group,n,mean,p\ncontrol,12,3.4,0.05\ntreated,14,5.1,0.01\nother,9,4.0,n.s.\nmore,11,4.2,0.2",
        "junk": "xqzvw kkjhg pplmn trwqs bbvcx zzxcv mnbvc lkjhg fdsqw",
    }
    rows = [(k, t, 1) for k, t in texts.items()] + [("none1", None, 1), ("none2", "", 1), ("none3", " \n\t ", 1), ("list", texts["list"], 1), (None, texts["prose"], 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, kind int")
    got = [(r.doc_id, r.kind) for r in q.classified(df, learned[0]).select("doc_id", "kind").collect()]
    assert len(got) == len(rows)
    for i, k in got:
        assert k == (None if (i or "").startswith("none") else i or "prose")


def test_statistics_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in q.with_statistics(docs).collect()}
    for r in docs.collect():
        t, s = r.text or "", got[r.doc_id]
        import re

        words = [w for w in re.split(q.BLANK, t) if w]
        assert s.n_chars == len(t) and s.n_words == len(words) and s.distinct_words == len(set(words))
        if words:
            solid = sum(map(len, words))
            assert s.mean_word_length == pytest.approx(solid / len(words))
            assert s.common_word_share == pytest.approx(sum(w.lower() in q.COMMON for w in words) / len(words))
            assert s.single_char_share == pytest.approx(sum(len(w) == 1 for w in words) / len(words))
            assert s.long_token_share == pytest.approx(sum(len(w) for w in words if len(w) > 24) / solid)


def test_words_are_parted_by_blanks_of_any_kind(spark, learned):
    prose = "The samples were kept at room temperature for a week, and the values of the control group did not change. It was not possible to repeat the test."
    rows = [("plain", prose)] + [(f"{ord(b):x}", prose.replace(" ", b)) for b in q.BLANKS] + [(f"only {ord(b):x}", f"{b} {b}") for b in q.BLANKS]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.asDict() for r in q.classified(df, learned[0]).collect()}
    stats = {r.doc_id: r.asDict() for r in q.with_statistics(df).collect()}
    same = ("n_words", "mean_word_length", "common_word_share", "distinct_word_share", "distinct_words", "single_char_share", "long_token_share", "symbol_share")
    for i, r in stats.items():
        if i.startswith("only"):
            assert r["n_words"] == 0 and r["symbol_share"] == 0 and got[i]["kind"] is None
        else:
            assert {f: r[f] for f in same} == {f: stats["plain"][f] for f in same} and got[i]["kind"] == "prose"


def test_words_of_texts_with_wide_blanks(spark, data):
    import re

    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if re.search(f"[{q.BLANKS}]", r.text or "")]
    got = {r.doc_id: r for r in q.with_statistics(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for r in docs:
        words = [w for w in re.split(q.BLANK, r.text) if w]
        assert got[r.doc_id].n_words == len(words) and got[r.doc_id].distinct_words == len(set(words))
    assert docs


def test_empty_table(spark, learned):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.classified(df, learned[0]).count() == 0


def test_learning_finds_a_threshold():
    x = np.random.default_rng(0).random((600, 3))
    kinds = np.where(x[:, 1] > 0.7, "junk.0", "prose.0")
    rules = q.induce(x, kinds)
    found = [op for f, op, v in rules[0][0] if f == 1 and abs(v - 0.7) < 0.03]
    assert found == [">"] and "case" in q.to_sql(rules, ["a", "b", "c"])
