import random
import re
import unicodedata

import numpy as np

from papyrine.llm import leakage as lk


def plain(text):
    t = unicodedata.normalize("NFKC", text or "").translate(dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF))).lower()
    return re.findall(r"[^\W_]+", t)


def brute(docs, items):
    out = set()
    for i, p in items:
        w = plain(p)
        k = min(12, len(w))
        for d, t in docs:
            x = plain(t)
            if k and any(x[a : a + k] == w[b : b + k] for a in range(len(x) - k + 1) for b in range(len(w) - k + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    lexicon = [f"w{i}" for i in range(60)] + ["the", "of", "and", "ﬁne", "ΑΒΓ", "naïve", "x²"]
    passage = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, passage(rng.choice([3, 8, 12, 13, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "the the the the the the the the the the the the the the")]
    items.append((94, items[0][1]))
    docs = []
    for d in range(120):
        body = passage(rng.randint(0, 90)).split()
        if rng.random() < 0.7:
            w = (rng.choice(items[:25])[1]).split()
            a = rng.randint(0, max(0, len(w) - 11))
            at = rng.randint(0, len(body))
            body[at:at] = w[a : a + rng.choice([10, 11, 12, 13, 40])]
        text = ", ".join(body) if d % 3 else "­".join([" ".join(body).upper()])
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "the " * 15), (502, "the " * 15)]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    pf = spark.createDataFrame([(*x, "z") for x in items], "item_id long, passage string, doc_id string")
    got = [tuple(r) for r in lk.matches(df, pf).where("exact").select("doc_id", "item_id").collect()]
    assert set(got) == brute(docs, items)
    assert got.count((502, 93)) == 2
    assert lk.matches(df.limit(0), pf).count() == 0 and lk.matches(df, pf.limit(0)).count() == 0


def test_several_blocks_find_the_same(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_passages.parquet")
    pairs = lambda: sorted(tuple(r) for r in lk.matches(docs, items).where("exact").select("doc_id", "item_id").collect())
    one = pairs()
    monkeypatch.setattr(lk, "RANK", 20)
    build = lk.build
    monkeypatch.setattr(lk, "build", lambda p: build(p, block_words=2000))
    assert one == pairs() and one
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.passage) for r in items.collect()])
    assert set(one) == want


def test_low_rank_loses_nothing():
    rng = random.Random(2)
    words = [[f"w{rng.randint(0, 80)}" for _ in range(30)] for _ in range(40)]
    model = lk.Model(list(enumerate(words)), rank=6)
    ids = np.full((7, 12), -1, dtype=np.int32)
    for k, w in enumerate(words):
        seq = [model.vocabulary[x] for x in w]
        ids[:] = -1
        ids.reshape(-1)[5:17] = seq[9:21]
        got = model.candidates(ids)
        assert k in got[1].tolist()


def test_singular_vectors():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 50)) @ np.diag(np.linspace(3, 0.1, 50))
    rows = [(np.arange(50), r) for r in a]
    v = lk.randomised_svd(rows, 50, 30)
    assert np.allclose((a @ v) @ v.T, a, atol=1e-6)


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(100):
        x, y = [rng.randint(0, 5) for _ in range(20)], [rng.randint(0, 6) for _ in range(30)]
        t = [[0] * 31 for _ in range(21)]
        for i in range(20):
            for j in range(30):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        assert lk.lcs_length(lk._masks(x), 20, y) == t[20][30]


def test_no_paraphrase_is_lost(spark):
    rng = random.Random(11)
    lexicon = [f"w{i}" for i in range(900)]
    long, short = rng.sample(lexicon[:400], 40), rng.sample(lexicon[400:], 11)
    other = [rng.sample(lexicon, 40) for _ in range(20)]
    items = [(0, " ".join(long)), (1, " ".join(short))] + [(k + 2, " ".join(o)) for k, o in enumerate(other)]
    filler = lambda n: [f"z{rng.randint(0, 9999)}" for _ in range(n)]
    changed = lambda w, every: [f"y{k}" if k % every == every - 1 else x for k, x in enumerate(w)]
    # Half of the passage in order, far from a paraphrase, in many places.
    weak = lambda: [*long[:11], "z", *long[12:20]]
    many = [x for _ in range(90) for x in weak() + filler(150)]
    spread = [y for x in long for y in [x, *filler(2)]]
    docs = {
        "many": many + changed(long, 8),
        "short": filler(50) + [*short[:5], "other", *short[6:]] + filler(50),
        "spread": filler(30) + spread + filler(30),
        "begins late": filler(36) + weak() + filler(4) + filler(12) + changed(long, 8) + filler(200),
        "weak": many, "none": filler(500),
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id string, text string")
    pf = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r for r in lk.matches(df, pf).collect()}
    assert {k for k in got if k[1] < 2} == {("many", 0), ("short", 1), ("spread", 0), ("begins late", 0)}
    assert got["many", 0].lcs_share == 35 / 40 and got["begins late", 0].lcs_share >= 35 / 40
    assert got["short", 1].lcs_share == 10 / 11 and got["spread", 0].lcs_share >= 0.7
    assert not any(r.exact for r in got.values())


def test_planted_paraphrases_are_recalled(spark, data):
    rng = random.Random(5)
    items = [(r.item_id, lk.words(r.passage)) for r in spark.read.parquet(f"{data}/eval_passages.parquet").collect()]
    items = [x for x in items if len(x[1]) >= 15]
    docs = []
    for i, w in items:
        # One word in ten changed, one in twenty lost, and no run of 12 left.
        kept = [f"zq{rng.randrange(99)}" if rng.random() < 0.1 else x for x in w if rng.random() >= 0.05]
        kept = [y for j, x in enumerate(kept) for y in ((x, f"xx{rng.randrange(99)}") if j % 10 == 9 else (x,))]
        docs.append((i, " ".join(["filler"] * 50 + kept + ["filler"] * 50)))
    found = lk.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, passage string"))
    got = found.collect()
    assert not any(r.exact for r in got if r.doc_id == r.item_id)
    assert sum(r.doc_id == r.item_id for r in got) >= 0.9 * len(items)


def test_many_blocks_are_read_in_one_pass(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/eval_passages.parquet")
    out = lk.matches(docs, items)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
