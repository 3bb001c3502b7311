"""Repair of text from scanned pages.

The corpus is read three times. First, words are counted, and a word is trusted when it has
a least count and is no misreading of a far more frequent one. Second, skip-gram vectors of
the most frequent trusted words are learned from all their co-occurrences with the most
frequent ones: the objective of skip-gram with negative sampling is taken over the exact
pair counts, so no pair is sampled. Third, each paper is repaired by itself: furniture is
found by position, sequence and repetition, words broken over lines are joined, and a word
that isn't trusted is linked to the trusted words it may be a misreading of by plausible
glyph edits, among which the vectors of its context choose. What is left is reflowed.

While all trusted words fit into the table of vectors, no text moves between machines.
Beyond, the words that papers ask for are looked up among all trusted words by joins, and
papers meet what was found for them; the table bounds the vectors only.
"""

from __future__ import annotations

import bisect
import copy
import difflib
import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.sources.tables import durable

#: What a scanner reads for a glyph (misread, glyph).
GLYPHS = (
    ("c", "e"), ("l", "i"), ("f", "t"), ("u", "n"), ("0", "o"), ("@", "a"), ("5", "s"), ("1", "l"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("b", "h"), ("9", "g"), ("6", "b"),
    ("vv", "w"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("1", "i"), ("8", "b"), ("3", "e"), ("$", "s"), ("|", "l"),
)
#: Letters read for digits.
DIGITS = {"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9"}
#: Words that follow a hanging hyphen ("pre- and post-treatment"), fixed values.
LINKING = frozenset("and or to und oder bis et ou y o e u".split())
HYPHENS = "-­¬‐‑"
#: Trusted words with vectors at most (their table is sent to every executor: 16,384 words
#: of 32 dimensions, 4 MB), least count of a trusted word, how many times more frequent the
#: source of a misreading is, words taken as contexts, window and dimensions.
MOST_WORDS, LEAST_COUNT, TIMES, CONTEXTS, WINDOW, DIMENSIONS = 16_384, 4, 12, 512, 2, 32
#: Longest word that is looked up as a misreading.
LONGEST = 40

#: Step and decay of the gradient ascent.
STEP, DECAY = 1.0, 0.01

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_BROKEN = re.compile(rf"\S+[{re.escape(HYPHENS)}][ \t]*\n\s*\S+")
_NUMBER_LINE = re.compile(r"^[\W_]*(?:(?:page|seite|pagina|página|p)\b\.?)?\s*([0-9lIiOoSsZzBb|]{1,5})(?:\s*(?:of|von|de|/)\s*[0-9lIiOoSsZzBb|]{1,5})?[\s\-–—\])}*~|]*$", re.I)
_EDGE_NUMBER = re.compile(r"^([0-9lIiOoSsZzBb|]{1,5})\s{2,}\S|\S\s{2,}([0-9lIiOoSsZzBb|]{1,5})$")
_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"^[^\w@|]*[0-9liIoOsSzZbBgG|]+(?:[.,][0-9liIoOsSzZbBgG|]+)*%?[^\w]*$")
_DIGIT_MAP = str.maketrans(DIGITS)


def core(token: str) -> str:
    """A word without leading and trailing characters other than letters and digits, in lower case."""
    return _EDGE.sub("", token).lower()


def _bare(token: str) -> str:
    return token.strip(".,;:!?()[]{}\"'“”‘’*_<>=+/\\-–—")


# ---------------------------------------------------------------- trusted words


def sources(word: str, edits: int = 1) -> set[str]:
    """Words of which ``word`` may be a misreading, by so many glyph edits at most."""
    found, layer = set(), {word}
    for _ in range(edits):
        layer = {w[:i] + good + w[i + len(bad) :] for w in layer for bad, good in GLYPHS for i in _at(w, bad)}
        found |= layer
    found.discard(word)
    return found


def _at(word: str, part: str) -> list[int]:
    out, i = [], word.find(part)
    while i >= 0:
        out.append(i)
        i = word.find(part, i + 1)
    return out


def _plausible(word: str) -> bool:
    """Whether a word has letters and isn't a number with misread digits."""
    return bool(_LETTERS.search(word)) and not (_NUMBER.match(word) and re.search(r"[0-9]", word))


def trusted(counts: dict[str, int]) -> dict[str, int]:
    """Words of a least count that aren't misreadings of words far more frequent than themselves."""
    good: dict[str, int] = {}
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n >= LEAST_COUNT and _plausible(w) and not any(good.get(s, 0) >= TIMES * n for s in sources(w)):
            good[w] = n
    return good


def trusted_table(counts: DataFrame) -> DataFrame:
    """The same of any number of words: word, n.

    A word falls when a source of it stands. Words without far more frequent sources stand
    from the start; each round lets those fall that have a source which surely stands, and a
    source is TIMES as frequent, so that there are few rounds.
    """
    able = counts.where(F.col("n") >= LEAST_COUNT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, s) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _plausible(w) for s in (w, *sources(w))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["word", "n", "s"])

    edges = durable(able.select("word", "n").mapInArrow(run, "word string, n long, s string"), "edges")
    words = edges.where("s = word").select("word", "n")
    pairs = durable(edges.join(words.select(F.col("word").alias("s"), F.col("n").alias("m")), "s").where(F.col("m") >= TIMES * F.col("n")).select("word", "s"), "pairs")
    fallen = None
    while not pairs.isEmpty():
        open_words = pairs.select(F.col("word").alias("s")).distinct()
        bad = durable(pairs.join(open_words, "s", "left_anti").select("word").distinct(), "fallen")
        fallen = bad if fallen is None else fallen.unionAll(bad)
        pairs = durable(pairs.join(bad, "word", "left_anti").join(bad.select(F.col("word").alias("s")), "s", "left_anti").select("word", "s"), "pairs")
    return durable(words if fallen is None else words.join(fallen, "word", "left_anti"), "trusted")


def word_counts(texts: DataFrame) -> DataFrame:
    """Words of all texts with their counts; words broken over lines aren't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                s = t.as_py()
                if s:
                    counts.update(_BROKEN.sub(" ", s).split() if "-\n" in s or not s.isascii() else s.split())
            if len(counts) > 400_000:
                yield _count_rows(counts)
                counts.clear()
        if counts:
            yield _count_rows(counts)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_rows(raw: Counter[str]) -> pa.RecordBatch:
    counts: Counter[str] = Counter()
    for w, n in raw.items():
        c = core(w)
        # Plain numbers are no words to learn from.
        if c and not c.replace(".", "").isdigit():
            counts[c] += n
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


# ---------------------------------------------------------------- skip-gram vectors


def pair_counts(texts: DataFrame, index: dict[str, int], contexts: int) -> DataFrame:
    """How often each trusted word stands within the window of each of the context words."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words) * contexts, dtype=np.int64)
        known: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0):
                s = t.as_py()
                if not s:
                    continue
                ids = []
                for w in s.split():
                    i = known.get(w)
                    if i is None:
                        i = words.get(core(w), -1)
                        if len(known) > 400_000:
                            known.clear()
                        known[w] = i
                    ids.append(i)
                a = np.array(ids, dtype=np.int64)
                for k in range(1, WINDOW + 1):
                    for x, y in ((a[:-k], a[k:]), (a[k:], a[:-k])):
                        ok = (x >= 0) & (y >= 0) & (y < contexts)
                        np.add.at(total, x[ok] * contexts + y[ok], 1) if ok.sum() < 64 else _add(total, x[ok] * contexts + y[ok])
        at = np.flatnonzero(total)
        for part in np.array_split(at, max(1, len(at) // 200_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part // contexts), pa.array(part % contexts), pa.array(total[part])], names=["w", "c", "n"])

    return texts.mapInArrow(run, "w long, c long, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))


def _add(total: np.ndarray, codes: np.ndarray) -> None:
    u, n = np.unique(codes, return_counts=True)
    total[u] += n


def skip_gram(pairs: np.ndarray, negatives: int = 5, rounds: int = 120, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors that maximise the skip-gram objective over pair counts.

    The expected negative samples of a pair enter by the product of its words' counts, so
    the gradient is exact. Pairs are damped to a power of 3/4 as negatives are.
    """
    n = pairs.astype(np.float64) ** 0.75
    total = max(n.sum(), 1.0)
    out, into = n.sum(1), n.sum(0)
    noise = negatives * np.outer(out, into) / total
    scale = 1.0 / (n + noise + 1.0).sum(1, keepdims=True)
    back = 1.0 / (n + noise + 1.0).sum(0, keepdims=True).T
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 0.1, (n.shape[0], DIMENSIONS))
    v = rng.normal(0, 0.1, (n.shape[1], DIMENSIONS))
    for _ in range(rounds):
        s = 1.0 / (1.0 + np.exp(-np.clip(u @ v.T, -20, 20)))
        g = n * (1 - s) - noise * s
        # Each row steps by its own size of counts; a slight decay keeps rare rows bounded.
        u, v = u + STEP * (g @ v) * scale - DECAY * u, v + STEP * (g.T @ u) * back - DECAY * v
    return u.astype(np.float32), v.astype(np.float32)


class Lexicon:
    """Trusted words with counts and vectors; chooses the source of a misread word.

    ``table`` holds all trusted words where ``counts`` has the most frequent of them only.
    """

    def __init__(self, counts: Mapping[str, int], u: np.ndarray, v: np.ndarray, table: DataFrame | None = None):
        self.counts, self.u, self.v, self.table = counts, u, v, table
        self.index = {w: i for i, w in enumerate(counts)}
        self.known: dict[str, list[str]] = {}
        self.settled: dict[str, str | None] = {}

    def for_paper(self, found: list[dict] | None) -> Lexicon:
        """With what was looked up among all trusted words for one paper."""
        own = copy.copy(self)
        more = {r["s"]: r["n"] for x in found or () for r in x["links"]}
        own.counts, own.settled = ChainMap(more, self.counts), {}
        own.known = defaultdict(list)
        for x in found or ():
            if x["word"] not in own.counts:
                own.known[x["word"]] = sorted(r["s"] for r in x["links"])
        own.links = own.known.__getitem__
        return own

    def join(self, token: str, next_tokens: list[str], context: list[str]) -> tuple[str, str] | None:
        return _join(token, next_tokens, context, self)

    def links(self, word: str) -> list[str]:
        """Trusted words that ``word`` may be a misreading of, by the fewest edits."""
        found = self.known.get(word)
        if found is None:
            found = []
            if word not in self.counts and len(word) <= LONGEST:
                for edits in (1, 2) if len(word) > 3 else (1,):
                    found = sorted(s for s in sources(word, edits) if s in self.counts)
                    if found:
                        break
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def choose(self, found: list[str], context: list[str]) -> str:
        """The word that fits its context best: skip-gram score and frequency."""
        if len(found) == 1:
            return found[0]
        near = [i for i in (self.index.get(c, -1) for c in context) if 0 <= i < len(self.v)]

        def score(w: str) -> float:
            # A word beyond the table has no vector, which speaks neither for nor against it.
            at = self.index.get(w)
            fit = sum(-math.log1p(math.exp(-float(self.u[at] @ self.v[i]) if at is not None else 0.0)) for i in near)
            return fit + 0.5 * math.log(self.counts[w])

        return max(found, key=lambda w: (score(w), w))

    def repair(self, token: str, context: Callable[[], list[str]]) -> str | None:
        """The whole repaired word of a misread token; None where nothing is wrong.

        Only the choice among several sources looks at the context; all else is remembered.
        """
        if token in self.settled:
            return self.settled[token]
        found = self._sources_of(token)
        if isinstance(found, list):
            if len(found) > 1:
                return core(self.choose(found, context()))
            found = core(found[0])
        if len(self.settled) > 400_000:
            self.settled.clear()
        self.settled[token] = found
        return found

    def _sources_of(self, token: str) -> str | list[str] | None:
        """What a token is: None where it is right, a repaired number, or its possible sources."""
        bare = _bare(token)
        raw, plain = bare.lower(), core(token)
        if not raw or plain in self.counts and raw == plain:
            return None
        if _NUMBER.match(bare):
            if any(c.isdigit() for c in bare) or len(bare) == 1 and bare not in "|gG":
                fixed = bare.translate(_DIGIT_MAP)
                return core(fixed) if fixed != bare and core(fixed) else None
        elif plain in self.counts and "@" not in raw:
            return None
        for w in dict.fromkeys((raw, plain)):
            found = self.links(w)
            if found:
                return found
        # A number after a sign, as in p<0.0l.
        m = re.match(r"^(.*[<>=~±])([0-9liIoOsSzZbB|.]*[0-9][0-9liIoOsSzZbB|.]*)$", bare)
        if m and m[2].translate(_DIGIT_MAP) != m[2]:
            return core(m[1] + m[2].translate(_DIGIT_MAP))
        return None


def learn(documents: DataFrame, text_col: str = "markdown_text") -> Lexicon:
    """Trusted words and their vectors, from all texts."""
    texts = documents.select(F.col(text_col).alias("t"))
    counts = durable(word_counts(texts), "words")
    # At most MOST_WORDS words come to the driver.
    top = counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(MOST_WORDS + 1).collect()
    table = None
    if len(top) <= MOST_WORDS:
        good = trusted({r.word: r.n for r in top})
    else:
        table = trusted_table(counts)
        good = {r.word: r.n for r in table.orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()}
    index = {w: i for i, w in enumerate(good)}
    contexts = min(CONTEXTS, max(1, len(index)))
    return Lexicon(good, *trained(pair_counts(texts, index, contexts), max(1, len(index)), contexts), table)


def trained(pairs: DataFrame, words: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and contexts from their pair counts, learned by one task.

    The task gets at most MOST_WORDS * CONTEXTS counts, whatever the corpus; only the vectors
    (some 2 MB) come to the driver.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((words, contexts))
        matrix[pdf["w"].to_numpy(), pdf["c"].to_numpy()] = pdf["n"].to_numpy()
        u, v = skip_gram(matrix)
        return pd.DataFrame({"side": [0] * len(u) + [1] * len(v), "i": [*range(len(u)), *range(len(v))], "x": [*u, *v]})

    numbers = pairs.select(F.col("w").cast("int"), F.col("c").cast("int"), F.col("n").cast("float"))
    got = numbers.groupBy(F.lit("all").alias("g")).applyInPandas(run, "side int, i int, x array<float>").toPandas().sort_values(["side", "i"])
    sides = [np.stack(part["x"].to_list()) if len(part) else np.zeros((n, DIMENSIONS)) for n, part in ((words, got[got["side"] == 0]), (contexts, got[got["side"] == 1]))]
    return sides[0].astype(np.float32), sides[1].astype(np.float32)


class _Asking:
    """Takes the place of a lexicon to note the words that a paper looks up."""

    def __init__(self):
        self.words: set[str] = set()

    def repair(self, token: str, context: Callable[[], list[str]]) -> None:
        self.words |= {_bare(token).lower(), core(token)}

    def join(self, token: str, next_tokens: list[str], context: list[str]) -> None:
        if next_tokens:
            rest = next_tokens[0].lstrip("\x0c")
            self.words |= {core(token[:-1] + rest), core(token[:-1] + "-" + rest), core(token[:-1]).split("-")[-1], core(rest).split("-")[0]}


def looked_up(papers: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``papers`` (doc_id, t) with what all trusted words say of the words each asks for.

    Adds ``found``, an array of word and links: the word itself where it is trusted, else
    its possible sources by the fewest edits. Words of the table of vectors are known
    everywhere and aren't looked up.
    """
    shared = papers.sparkSession.sparkContext.broadcast(set(lexicon.counts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows: list[tuple[str, str]] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                asking = _Asking()
                repair_paper(t.as_py() or "", asking)
                rows += [(k, w) for w in asking.words if w and w not in known]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["k", "word"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for start in range(0, len(words), 1000):
                rows = [(w, 0, w) for w in words[start : start + 1000]]
                for w in words[start : start + 1000]:
                    if len(w) <= LONGEST:
                        one = sources(w)
                        rows += [(w, 1, x) for x in one]
                        if len(w) > 3:
                            rows += [(w, 2, x) for x in sources(w, 2) - one]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))], names=["word", "edits", "s"])

    keyed = papers.withColumn("k", F.sha2("t", 256))
    asked = durable(keyed.where("t is not null").select("k", "t").mapInArrow(ask, "k string, word string").distinct(), "asked")
    edges = asked.select("word").distinct().mapInArrow(spread, "word string, edits int, s string")
    hit = edges.join(lexicon.table.select(F.col("word").alias("s"), "n"), "s").groupBy("word", "edits").agg(F.collect_list(F.struct("s", "n")).alias("links"))
    best = hit.groupBy("word").agg(F.min_by("links", "edits").alias("links"))
    found = asked.join(best, "word").groupBy("k").agg(F.collect_list(F.struct("word", "links")).alias("found"))
    return keyed.join(found, "k", "left").select("doc_id", "t", "found")


def _each(batch: pa.RecordBatch, own: Lexicon) -> Iterator[tuple[str | None, str | None, Lexicon]]:
    """Id and text of each paper with the lexicon that holds for it."""
    for r in range(batch.num_rows):
        yield batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), own.for_paper(batch.column(2)[r].as_py()) if batch.num_columns > 2 else own


# ---------------------------------------------------------------- one paper


def _key(line: str) -> str:
    """A line's letters, without digits and marks, for comparing running lines."""
    return " ".join(_LETTERS.findall(line.lower()))


def _value(s: str) -> int:
    t = s.lower().translate(_DIGIT_MAP)
    return int(t) if t.isdigit() else -1


def looks_scanned(lines: list[str]) -> bool:
    """Lines as a page has them: many, and few of them longer than a page is wide."""
    body = [len(x) for x in lines if x.strip() and x[0] not in "#|"]
    return len(body) >= 8 and sum(n <= 110 for n in body) >= 0.75 * len(body)


def _page_numbers(lines: list[str]) -> tuple[set[int], set[int]]:
    """Lines that hold only a page number, and lines that hold one beside other text.

    Numbers that go up by one from page to page form the chain; a list of counts in the
    body doesn't.
    """
    found: list[tuple[int, int, bool]] = []
    for i, x in enumerate(lines):
        s = x.strip()
        if not s or s[0] in "#|":
            continue
        m = _NUMBER_LINE.match(s)
        if m and not s.endswith(".") and (any(c.isdigit() for c in m[1])):
            found.append((i, _value(m[1]), True))
        elif (e := _EDGE_NUMBER.search(s)) and (n := _value(e[1] or e[2])) >= 0 and any(c.isdigit() for c in (e[1] or e[2])):
            found.append((i, n, False))
    if not found:
        return set(), set()
    best, link = [1] * len(found), [-1] * len(found)
    # Of each value, the places so far with the longest chain that ends there up to each place.
    ends: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}
    for b, (at, n, _) in enumerate(found):
        options = []
        for step in (1, 2, 3):
            places, longest = ends.get(n - step, ([], []))
            k = bisect.bisect_right(places, at - 4 * step) - 1
            if k >= 0:
                length, a = longest[k]
                options.append((length + (2 if step == 1 else 1), -a))
        if options and max(options)[0] > 1:
            best[b], link[b] = max(options)[0], -max(options)[1]
        places, longest = ends.setdefault(n, ([], []))
        places.append(at)
        longest.append(longest[-1] if longest and longest[-1][0] >= best[b] else (best[b], b))
    k = max(range(len(found)), key=lambda j: (best[j], found[j][2], -j))
    chain = set()
    if best[k] > 1:
        while k >= 0:
            chain.add(k)
            k = link[k]
    else:
        # One page number only: it stands alone, between pages.
        places = {f[0] for f in found}
        own = [j for j, f in enumerate(found) if f[2] and f[0] - 1 not in places and f[0] + 1 not in places]
        chain = {own[0]} if len(own) == 1 and not lines[max(0, found[own[0]][0] - 1)].rstrip().endswith(":") else set()
    return {found[j][0] for j in chain if found[j][2]}, {found[j][0] for j in chain if not found[j][2]}


def _neighbours(lines: list[str], left_out: set[int]) -> tuple[list[int], list[int]]:
    """Of each line the nearest before and after it that are neither blank nor left out."""
    before, after = [-1] * len(lines), [len(lines)] * len(lines)
    last = -1
    for i, x in enumerate(lines):
        before[i] = last
        if x.strip() and i not in left_out:
            last = i
    last = len(lines)
    for i in range(len(lines) - 1, -1, -1):
        after[i] = last
        if lines[i].strip() and i not in left_out:
            last = i
    return before, after


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """Running lines and page-number lines of one paper."""
    numbers, beside = _page_numbers(lines)
    keys = {i: _key(x) for i, x in enumerate(lines) if x.strip() and x.strip()[0] not in "#|" and i not in numbers}
    title, authors = "", ""
    for i, x in enumerate(lines):
        if x.startswith("# "):
            title = _key(x)
            authors = next((_key(y) for y in lines[i + 1 : i + 4] if y.strip()), "")
            top = i
            break
    else:
        top = -1
    first = authors.split()[0] if authors else ""
    again = f"{first} et al"
    same: dict[str, list[int]] = defaultdict(list)
    for i, k in keys.items():
        same[k].append(i)
    hints = {i for i, k in keys.items() if k and i != top and (k == title or i in beside or len(same[k]) >= 2 or (first and k == again))}
    before, after = _neighbours(lines, set())
    before_body, after_body = _neighbours(lines, numbers | hints)

    def at_edge(i: int, running: set[int]) -> bool:
        """At a page's edge: beside other furniture, a form feed, or the paper's ends."""
        if lines[i].startswith("\x0c"):
            return True
        for j in (before[i], after[i]):
            if not 0 <= j < len(lines) or j in numbers or j in running or lines[j].startswith("\x0c") or (j < i and j < top and i < top):
                return True
        return False

    def interrupts(i: int) -> bool:
        """Body text runs on from the line before to a line after, across this one."""
        a, b = before_body[i], after_body[i]
        if a < 0 or b >= len(lines):
            return True
        earlier, later = lines[a].rstrip(), lines[b].lstrip("\x0c ")
        return earlier[-1:] not in ".!?:" and (later[:1].islower() or later[:1].isdigit() or earlier[-1:] in HYPHENS)

    @lru_cache(None)
    def repeats(k: str) -> bool:
        """Whether a line that comes again stands at pages' edges often enough."""
        own = same[k]
        placed = sum(at_edge(j, hints) or interrupts(j) for j in own)
        # Some pages break between paragraphs, where a line interrupts nothing.
        return (placed > len(own) / 2 or (len(own) >= 3 and placed >= len(own) / 4)) and own[-1] - own[0] >= 5 and not any(lines[j].startswith("  ") for j in own)

    sure: set[int] = set()
    for i in sorted(hints):
        k, s = keys[i], lines[i].strip()
        own = k == title or i in beside or bool(first and k == again)
        ends = s.endswith((".", "!", "?", ",", ";")) and not k.endswith("et al")
        if own and (at_edge(i, hints) or interrupts(i) or len(same[k]) >= 2):
            sure.add(i)
        elif not own and not ends and len(k.split()) >= 2 and not s.lstrip("\x0c")[:1].islower() and repeats(k):
            sure.add(i)

    # The same lines with misread characters. Letters in common bound the likeness from above.
    def alike(k: str, m: str, least: float) -> bool:
        common = sum((letters(k) & letters(m)).values())
        return 2 * common >= least * (len(k) + len(m)) and difflib.SequenceMatcher(None, k, m).ratio() >= least

    letters = lru_cache(None)(Counter)
    for i, k in keys.items():
        if first and i not in sure and len(lines[i].strip()) < 60 and k.endswith((" al", " a")) and alike(k, again, 0.8):
            sure.add(i)
    models: dict[int, list[str]] = defaultdict(list)
    for m in sorted({keys[i] for i in sure if len(keys[i]) > 8} | ({title} if title else set())):
        models[len(m)].append(m)
    like_model = lru_cache(None)(lambda k: any(alike(k, m, 0.86) for n in range(len(k) - 6, len(k) + 7) for m in models.get(n, ())))
    for i, k in keys.items():
        if i not in sure and i != top and len(k) > 8 and (at_edge(i, sure) or interrupts(i)) and like_model(k):
            sure.add(i)
    return sure, numbers


def repair_paper(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, str, str]], str]:
    """Findings (line number, kind, word) in a scanned paper, and its repaired text.

    A text that doesn't look scanned gives no findings and itself.
    """
    lines = text.split("\n")
    if not looks_scanned(lines):
        return [], text
    running, numbers = furniture(lines)
    found = [(i + 1, "running_line", "") for i in running] + [(i + 1, "page_number", "") for i in numbers]
    body = [i for i in range(len(lines)) if i not in running and i not in numbers]
    full = [i for i in body if lines[i].strip()]
    following = dict(zip(full, full[1:]))
    clean: dict[int, list[str]] = {}
    taken: dict[int, int] = {}
    for i in full:
        tokens = lines[i].split()
        if lines[i].startswith("|"):
            clean[i] = tokens
            continue
        start = taken.get(i, 0)
        out: list[str] = []
        for k in range(start, len(tokens)):
            t = tokens[k]
            if k == len(tokens) - 1 and len(t) > 1 and t[-1] in HYPHENS and t[-2].isalnum() and i in following and taken.get(i, 0) <= k:
                joined = lexicon.join(t, lines[following[i]].split(), [core(x) for x in tokens[max(0, k - WINDOW) : k]])
                if joined is not None:
                    word, whole = joined
                    found.append((i + 1, "hyphen_break", word))
                    out.append(whole)
                    taken[following[i]] = 1
                    continue
            fixed = lexicon.repair(t, lambda: [core(x) for x in tokens[max(0, k - WINDOW) : k] + tokens[k + 1 : k + 1 + WINDOW]])  # noqa: B023
            if fixed is not None:
                found.append((i + 1, "misread", fixed))
                out.append(_dress(t, fixed))
            else:
                out.append(t)
        clean[i] = out
    return sorted(found), reflow(lines, body, clean)


def _join(token: str, next_tokens: list[str], context: list[str], lexicon: Lexicon) -> tuple[str, str] | None:
    """The word begun by ``token`` and ended by the next line's first; None for a hanging hyphen."""
    if not next_tokens or not next_tokens[0].lstrip("\x0c")[:1].isalnum():
        return None
    rest = next_tokens[0].lstrip("\x0c")
    one, two = core(token[:-1] + rest), core(token[:-1] + "-" + rest)
    counts = lexicon.counts
    if core(rest) in LINKING and one not in counts and two not in counts:
        return None
    if (not rest[0].isalpha() or rest[0].isupper()) and one not in counts and two not in counts:
        return None
    if counts.get(two, 0) > counts.get(one, 0):
        word, whole = two, token[:-1] + "-" + rest
    elif one in counts:
        word, whole = one, token[:-1] + rest
    else:
        word, whole = one, token[:-1] + rest
        for w in (one, two):
            links = lexicon.links(w)
            if links:
                word = lexicon.choose(links, context)
                whole = _dress(whole, word)
                break
        else:
            # Unknown either way: a part that is a word by itself speaks for a compound.
            parts = core(token[:-1]).split("-")[-1], core(rest).split("-")[0]
            if token[-1] == "-" and all(p in counts and len(p) > 3 for p in parts):
                word, whole = two, token[:-1] + "-" + rest
    return word, whole


def _dress(token: str, fixed: str) -> str:
    """The repaired word with the token's surrounding marks and first capital."""
    lead = re.match(r"^[^\w@|]*", token)[0]
    tail = re.search(r"[^\w%]*$", token)[0] if len(lead) < len(token) else ""
    body = token[len(lead) :]
    if body[:1].isupper():
        fixed = fixed[:1].upper() + fixed[1:]
    return lead + fixed + ("%" if token.rstrip(".,;:)").endswith("%") and not fixed.endswith("%") else "") + tail.lstrip("%")


def reflow(lines: list[str], body: list[int], clean: dict[int, list[str]]) -> str:
    """Continuous paragraphs from the body's lines.

    A paragraph ends at a blank line, a heading, a table row or an indented line; one that
    a page break cut in two is put together again.
    """
    paragraphs: list[list[str]] = []
    kinds: list[str] = []
    fresh = True
    last = -2
    for i in body:
        x = lines[i]
        if i not in clean:
            fresh = True
            continue
        kind = "mark" if x[0] in "#|" else "text"
        indented = x.lstrip("\x0c").startswith("  ")
        broken = i - last > 1
        tokens = clean[i]
        if not tokens:
            last = i
            continue
        cut = paragraphs and kind == "text" and kinds[-1] == "text" and paragraphs[-1][-1][-1] not in ".!?:" and tokens[0][:1].islower() and not indented
        if kind == "text" and paragraphs and kinds[-1] == "text" and not indented and (not fresh or (broken and cut) or cut):
            paragraphs[-1] += tokens
        else:
            paragraphs.append(list(tokens))
            kinds.append(kind)
        fresh, last = False, i
    out = []
    for k, (p, kind) in enumerate(zip(paragraphs, kinds)):
        table = p[0].startswith("|")
        out.append(("\n" if table and k and paragraphs[k - 1][0].startswith("|") else "\n\n") + " ".join(p) if out else " ".join(p))
    return "".join(out)


def findings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "markdown_text", lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, line_no, kind and word of everything that scanning left in the papers.

    Null and empty texts and papers that don't look scanned give no rows; repeated rows
    count once; lines are counted from 1 at line feeds only.
    """
    lexicon = learn(documents, text_col) if lexicon is None else lexicon
    shared = documents.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.u, lexicon.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for d, s, lexicon_of in _each(batch, own):
                if s:
                    rows += [(d, *f) for f in repair_paper(s, lexicon_of)[0]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "line_no", "kind", "word"])

    # Distinct by the small findings, not by the texts.
    papers = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("t"))
    papers = papers if lexicon.table is None else looked_up(papers, lexicon)
    return papers.mapInArrow(run, "doc_id string, line_no int, kind string, word string").distinct()


def repaired(documents: DataFrame, id_col: str = "doc_id", text_col: str = "markdown_text", lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id and text of every distinct paper, as continuous readable paragraphs.

    Papers that don't look scanned keep their text; null stays null.
    """
    lexicon = learn(documents, text_col) if lexicon is None else lexicon
    shared = documents.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.u, lexicon.v))
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            texts = [None if s is None else repair_paper(s, lexicon_of)[1] for _, s, lexicon_of in _each(batch, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    papers = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("t")).dropDuplicates()
    papers = papers if lexicon.table is None else looked_up(papers, lexicon)
    return papers.mapInArrow(run, schema)
