import re

from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import split as sp

TEXT = st.text(alphabet=st.sampled_from("abcde fgh. A1\n\n \t\r!é𝒳"), min_size=40, max_size=400)


def level(text, limit):
    ok = lambda parts: all(len(p.strip(" \t\r\n")) <= limit for p in parts)
    if ok(re.split(r"\n(?:[ \t\r]*\n)+", text)):
        return "paragraph"
    if ok(text.split("\n")):
        return "line"
    if ok(re.split(r"\n|(?<=[.!?])[ \t\r]+(?=[A-Z0-9])", text)):
        return "sentence"
    return "hard"


@settings(max_examples=500, deadline=None)
@given(TEXT, st.integers(12, 60), st.integers(0, 10))
def test_pieces_lose_nothing_and_fit(text, limit, overlap):
    kind, cuts = sp.split_text(text, limit, overlap)
    assert kind == level(text, limit)
    assert "".join(text[c:e] for _, c, e in cuts) == text
    for k, (b, c, e) in enumerate(cuts):
        assert len(text[b:e].strip(" \t\r\n")) <= limit
        assert 0 <= c - b <= overlap and (k > 0 or b == c)
        assert k == 0 or b >= cuts[k - 1][1]
    if kind != "hard":
        found = sp.boundaries(text)
        least = {"paragraph": sp.PARAGRAPH, "line": sp.LINE, "sentence": sp.SENTENCE}[kind]
        assert all(found[c] >= least for _, c, _ in cuts[1:])


def test_pieces_are_balanced():
    text = " ".join(f"Sentence number {i} ends here." for i in range(200))
    _, cuts = sp.split_text(text, 900)
    sizes = [e - c for _, c, e in cuts]
    assert max(sizes) - min(sizes) < 0.2 * 900 and len(cuts) <= -(-len(text) // (900 - 120)) + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=40), st.integers(60, 90))
def test_uneven_parts_take_the_fewest_pieces(lengths, limit):
    text = "\n\n".join("x" * n for n in lengths)
    found = sp.boundaries(text)
    cuts = sp._fewest(text, sorted(found), limit)
    assert sp._parts_fit(text, cuts, limit)
    # First fit from the left needs the fewest pieces when boundaries are given.
    n, start = 1, 0
    for k, size in enumerate(lengths):
        if sum(lengths[start : k + 1]) + 2 * (k - start) > limit:
            n, start = n + 1, k
    assert len(cuts) + 1 == n


def test_pieces_between_far_boundaries_are_spread_evenly():
    # No boundary is near an equal target, whatever the number of pieces up to many.
    lengths = [500, 10, 500, 10, 500, 880, 20, 20, 20, 500, 500, 30] * 8
    text = "\n\n".join("y" * n for n in lengths)
    kind, cuts = sp.split_text(text, 900, 0)
    sizes = [len(text[c:e].strip()) for _, c, e in cuts]
    assert kind == "paragraph" and max(sizes) <= 900 and "".join(text[c:e] for _, c, e in cuts) == text
    greedy, total = [], 0
    for n in lengths:
        total = total + 2 + n if total and total + 2 + n <= 900 else (greedy.append(total) or n)
    greedy.append(total)
    assert len(sizes) == len([g for g in greedy if g]) and sum(x * x for x in sizes) <= sum(x * x for x in greedy)


def test_very_long_word():
    kind, cuts = sp.split_text("x" * 100_000, 900)
    assert kind == "hard" and all(e - b <= 900 for b, _, e in cuts)


def test_current_rows(spark):
    long, longer = "a. B" * 300, "word " * 300
    rows = [("x", long, 1, 9), ("x", "short", 2, 9), ("y", "short", 1, 9), ("y", longer, 2, 9), ("z", None, 1, 9), (None, longer, None, 9), ("y", longer, 2, 9), ("w", "", 3, 9)]
    df = spark.createDataFrame(rows, "id string, content string, ingested_at int, item_kind int")
    items = sp.current_items(df, "chunk", "id", "content", "ingested_at", 900)
    assert sorted((r.item_id or "") for r in items.collect()) == ["", "y"]
    got = {(r.item_id, r.cut) for r in sp.pieces(items).collect()}
    assert got == {("y", "hard"), (None, "hard")}
    assert sp.pieces(items.limit(0)).count() == 0
