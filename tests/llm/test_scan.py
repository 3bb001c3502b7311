"""Made papers, printed on pages with noise whose places are known."""

import random

import pytest

from papyrine.llm import scan

NOUNS = "haematocrit calibrator specimen sensitivity laboratory procedure temperature concentration measurement observation incubation preparation reference interval instrument hospital clinic patient serum plasma".split()
VERBS = "improved reduced described remained compared determined validated estimated".split()
GLYPHS = {"e": "c", "i": "l", "o": "0", "m": "rn", "n": "u", "d": "cl", "a": "@", "h": "b"}


def sentence(r):
    return " ".join(["The", r.choice(NOUNS), "of", "the", r.choice(NOUNS), r.choice(VERBS), "with", "the", r.choice(NOUNS), "and", "from", "this", r.choice(NOUNS), "in", str(r.randint(10, 99)), "cases."])


def paper(r, doc, scanned=True):
    """Text and the findings planted in it."""
    if not scanned:
        return "# Title of " + doc + "\n\n" + "\n\n".join(" ".join(sentence(r) for _ in range(6)) for _ in range(6)), set()
    title = f"The {r.choice(NOUNS)} of the {r.choice(NOUNS)} in {r.choice(NOUNS)}"
    words = " ".join(sentence(r) for _ in range(60)).split()
    lines, truth, out, width = [], set(), [], 60
    rows: list[list] = [[]]
    for w in words:
        if sum(len(x) + 1 for x, _ in rows[-1]) + len(w) > width:
            rows.append([])
        if len(w) > 8 and w.isalpha() and not rows[-1] and len(rows) > 1 and r.random() < 0.5:
            k = r.randint(3, len(w) - 3)
            rows[-2].append((w[:k] + r.choice("-­¬"), ("hyphen_break", w.lower())))
            rows[-1].append((w[k:], None))
            continue
        if len(w) > 6 and w.isalpha() and w.lower() in NOUNS and r.random() < 0.04:
            k = r.choice([i for i, c in enumerate(w) if c in GLYPHS])
            rows[-1].append((w[:k] + GLYPHS[w[k]] + w[k + 1 :], ("misread", w.lower())))
            continue
        rows[-1].append((w, None))
    lines = ["# " + title, "", "Smith and co-workers", ""]
    page = 210
    for n, row in enumerate(rows):
        if n and n % 15 == 0:
            for kind, text in (("running_line", "Archive of Sample Papers, vol. 4"), ("page_number", f"- {page} -"), ("running_line", title.upper() if page % 2 else "Smith et al.")):
                lines.append(text)
                truth.add((len(lines), kind, ""))
            page += 1
        lines.append(" ".join(x for x, _ in row))
        truth |= {(len(lines), *f) for _, f in row if f}
    del out
    return "\n".join(lines), truth


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    texts = {f"d{i}": paper(r, f"d{i}", i % 2 == 0) for i in range(60)}
    rows = [(d, t, i) for i, (d, (t, _)) in enumerate(texts.items())]
    rows += [rows[0][:2] + (99,), ("null", None, 0), ("empty", "", 0), (None, "short\ntext", 0)]
    return texts, spark.createDataFrame(rows, "doc_id string, markdown_text string, kind int")


def test_findings_against_planted_cases(made):
    texts, df = made
    got = [(r.doc_id, r.line_no, r.kind, r.word) for r in scan.findings(df).collect()]
    want = {(d, *f) for d, (_, truth) in texts.items() for f in truth}
    assert len(got) == len(set(got))
    right = len(want & set(got))
    assert right / len(want) > 0.97 and right / len(got) > 0.97


def test_repaired_text_is_continuous(made):
    texts, df = made
    got = {r.doc_id: r.text for r in scan.repaired(df).collect()}
    assert got["null"] is None and got["empty"] == "" and got["d1"] == texts["d1"][0]
    t = got["d0"]
    assert "Archive" not in t and "¬" not in t and "- 2" not in t
    assert t.count("\n\n") == 2 and "\n" not in t.split("\n\n")[2]


def test_empty_table(made):
    _, df = made
    assert scan.findings(df.limit(0)).count() == 0


def lexicon(words):
    import numpy as np

    counts = {w: 1000 for w in words}
    z = np.zeros((len(words), 4), np.float32)
    return scan.Lexicon(counts, z, z)


def test_words_and_numbers():
    lx = lexicon(["with", "modern", "data", "cost-effectiveness", "dose", "p<0.01", "iron"])
    none = lambda: []
    fix = lambda t: lx.repair(t, none)
    assert fix("vvith") == "with" and fix("rnodern,") == "modern" and fix("d@ta") == "data" and fix("@") is None
    assert (fix("l06"), fix("Z4"), fix("1B.5%"), fix("(9S)"), fix("105")) == ("106", "24", "18.5", "95", None)
    assert fix("with") is None and fix("unheard") is None and fix("cost-cffectiveness") == "cost-effectiveness"
    # A number's zeros and ones stay letters in words.
    assert fix("lr0n") == "iron"


def test_hanging_and_own_hyphens():
    lx = lexicon(["cost-effectiveness", "infection", "treatment", "post-treatment", "values"])
    assert scan._join("cost-", ["effectiveness,"], [], lx)[0] == "cost-effectiveness"
    assert scan._join("in-", ["fection"], [], lx)[0] == "infection"
    assert scan._join("Pre-", ["and"], [], lx) is None and scan._join("x-", ["(y"], [], lx) is None


def test_lists_of_numbers_are_no_page_numbers():
    body = ["some words that go on and on in the text"] * 6
    lines = [*body, "Counts:", "3101", "2890", "3007", *body, "12", *body, "13", *body, "14", *body]
    pages, _ = scan._page_numbers(lines)
    assert [lines[i] for i in sorted(pages)] == ["12", "13", "14"]


def test_vectors_put_words_near_their_contexts():
    import numpy as np

    n = np.array([[50, 0], [48, 1], [0, 50], [1, 45]], float)
    u, v = scan.skip_gram(n)
    s = u @ v.T
    assert (s[:2, 0] > s[:2, 1]).all() and (s[2:, 1] > s[2:, 0]).all()


def test_words_beyond_the_table_of_vectors_are_trusted(made, monkeypatch):
    texts, df = made
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    whole, text = rows(scan.findings(df)), rows(scan.repaired(df).where("text is not null"))
    monkeypatch.setattr(scan, "MOST_WORDS", 12)
    few = rows(scan.findings(df))
    want = {(d, *f) for d, (_, truth) in texts.items() for f in truth}
    assert few == whole and len(want & {tuple(x) for x in few}) / len(want) > 0.97
    assert rows(scan.repaired(df).where("text is not null")) == text
    assert scan.repaired(df).where("text is null").count() == scan.repaired(df).where("doc_id = 'null'").count()


def test_least_count_does_not_grow_with_the_corpus(spark, monkeypatch):
    counts = spark.createDataFrame([("the", 900_000_000), ("specimen", 5), ("once", 3)], "word string, n long")
    monkeypatch.setattr(scan, "word_counts", lambda texts: counts)
    lx = scan.learn(spark.createDataFrame([("d", "the specimen")], "doc_id string, markdown_text string"))
    assert set(lx.counts) == {"the", "specimen"} and lx.repair("spccimen", lambda: []) == "specimen"


def test_trusted_table_is_trusted_of_all_words(spark):
    r = random.Random(8)
    counts = {w: r.choice([3, 4, 9, 60, 800, 10_000, 200_000]) for _ in range(3000) for w in ["".join(r.choice("celirnmdtf01") for _ in range(r.randint(2, 4)))]}
    # A chain: the third stands as the second falls.
    counts |= {"modem": 300_000, "rnodem": 2000, "rnodern": 100, "ioem": 144 * 144, "loem": 144 * 12, "locm": 144}
    got = scan.trusted_table(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {x.word: x.n for x in got.collect()} == scan.trusted(counts)


def test_furniture_of_a_very_long_paper_takes_time_in_proportion():
    import time

    def lines(n):
        return ["Running header of the paper" if i % 20 == 0 else str(i // 20 + 1) if i % 20 == 19 else f"some body text that goes on number word{i % 37} and" for i in range(n)]

    began = time.time()
    running, numbers = scan.furniture(lines(16_000))
    assert time.time() - began < 2
    assert running == set(range(0, 16_000, 20)) and numbers == set(range(19, 16_000, 20))
