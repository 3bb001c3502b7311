"""Evaluation passages that leak into a corpus, by latent semantic retrieval.

Passages become TF-IDF vectors; a randomised SVD gives their latent space. A block of
passages, of bounded size, is decomposed by one task, so a large evaluation set is
decomposed in parallel. Blocks are searched together, as many as a broadcast of bounded
size holds, so that the documents are read once for all of them. Documents are cut into
overlapping windows of words, projected into the latent space, and compared with every
passage of a block by cosine. Candidates are then checked by the longest common subsequence with the
passage, by the answer's words, and by the exact rule for consecutive words.

The candidate search loses no run. Windows are twice as long as the run of words looked
for and start once per run length, so each run lies within a window. For each passage the
least product with any window that holds such a run is known from the passage alone. What
the SVD leaves out of a product is at most the product of the lengths that it leaves out of
passage and window; with that as a margin, every window that could hold a run reaches the
bound at any rank. Paraphrases are what the thresholds say: every window that reaches
the least cosine is looked at with its surroundings, a passage's length at each side.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the run looked for; words of passages in one block (a passage is never parted, so
#: one beyond that is a block by itself); latent dimensions at most. A model takes some
#: 4 * rank + 250 bytes for each word of its passages.
RUN, BLOCK_WORDS, RANK = 12, 32_000, 64
#: Bytes of models that are broadcast together and searched in one pass over the documents.
PASS_BYTES = 96 << 20
#: Paraphrases: least cosine (of the window's words that passages have, in the latent space,
#: with whole lengths), share of the passage in the common subsequence, and share of
#: the answer's words.
COSINE, LCS_SHARE, ANSWER_SHARE = 0.4, 0.7, 0.75
_DROPPED = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF))
_WORD = re.compile(r"[^\W_]+").findall
_ASCII_WORD = re.compile(r"[a-z0-9]+").findall


def words(text: str | None) -> list[str]:
    """Words of a text brought to NFKC, freed of invisible marks and lower-cased."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD(text.lower())
    return _WORD(unicodedata.normalize("NFKC", text).translate(_DROPPED).lower())


def randomised_svd(rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (width x rank) of a sparse matrix of (ids, values) rows."""
    n = len(rows)
    k = min(rank, n, width)
    rng = np.random.default_rng(seed)
    probe = rng.standard_normal((width, min(n, width, k + 8)))

    def times(x: np.ndarray) -> np.ndarray:
        return np.stack([v @ x[i] for i, v in rows]) if n else np.zeros((0, x.shape[1]))

    def transposed(y: np.ndarray) -> np.ndarray:
        out = np.zeros((width, y.shape[1]))
        for (i, v), r in zip(rows, y):
            out[i] += v[:, None] * r[None, :]
        return out

    q, _ = np.linalg.qr(times(probe))
    for _ in range(3):
        z, _ = np.linalg.qr(transposed(q))
        q, _ = np.linalg.qr(times(z))
    _, _, vt = np.linalg.svd(transposed(q).T, full_matrices=False)
    return vt[:k].T


class Model:
    """Latent space of one block of passages, with what the checks need."""

    def __init__(self, items: list[tuple[int, list[str]]], rank: int = RANK, run: int = RUN):
        items = [(i, w) for i, w in items if w]
        self.items = [i for i, _ in items]
        self.run = run
        self.vocabulary: dict[str, int] = {}
        sequences = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int32) for _, w in items]
        self.sequences = sequences
        self.need = np.array([min(run, len(s)) for s in sequences], dtype=np.int64)
        width, n = len(self.vocabulary), len(items)
        df = np.bincount(np.concatenate([np.unique(s) for s in sequences]) if n else [], minlength=width)
        self.idf = np.log((1 + n) / (1 + df)) + 1
        rows, least = [], []
        for s, need in zip(sequences, self.need):
            ids, tf = np.unique(s, return_counts=True)
            rows.append((ids, tf * self.idf[ids]))
            gain = dict(zip(ids.tolist(), (tf * self.idf[ids] ** 2).tolist()))
            g = np.array([gain[x] for x in s.tolist()])
            c = np.concatenate([[0], np.cumsum(g)])
            least.append((c[need:] - c[:-need]).min())
        v = randomised_svd(rows, width, rank)
        self.latent = np.stack([x @ v[i] for i, x in rows]).astype(np.float32) if n else np.zeros((0, 0), np.float32)
        full = np.array([np.sqrt((x**2).sum()) for _, x in rows])
        self.left_out = np.sqrt(np.maximum(full**2 - (self.latent.astype(float) ** 2).sum(1), 0))
        self.least = np.array(least)
        self.norm = full + 1e-9
        # One more row, of zeros, for words that no passage has.
        self.words = np.vstack([v * self.idf[:, None], np.zeros((1, v.shape[1]))]).astype(np.float32) if n else np.zeros((1, 0), np.float32)
        self.weight = np.append(self.idf, 0).astype(np.float32)
        # Runs to look for, by length: hashes in order, with passage and place of each.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(self.need.tolist())):
            of = [i for i in range(n) if self.need[i] == k]
            h = np.concatenate([_gram_hashes(sequences[i], k) for i in of])
            sizes = [len(sequences[i]) - k + 1 for i in of]
            order = np.argsort(h, kind="stable")
            self.runs[k] = h[order], np.repeat(of, sizes)[order], np.concatenate([np.arange(m) for m in sizes])[order]
        self.answers = []
        for s in sequences:
            # What an answer states: its numbers and the rarer half of its words.
            back = set(s.tolist())
            cut = np.median(self.idf[list(back)])
            self.answers.append({x for x in back if self.idf[x] > cut} or back)
        names = {k: w for w, k in self.vocabulary.items()}
        for a, s in zip(self.answers, sequences):
            a |= {x for x in set(s.tolist()) if names[x].isdigit()}
        self.masks = [_masks(s.tolist()) for s in sequences]
        # Which passage has which word, hashed: as large as the passages are long. It may hold
        # a word too many, never one too few, which is all that its uses need.
        size = 1 << max(10, (16 * sum(map(len, sequences))).bit_length())
        self.held = np.zeros(size, bool)
        for k, s in enumerate(sequences):
            self.held[self._slot(k, s)] = True

    def _slot(self, passage: np.ndarray | int, word: np.ndarray) -> np.ndarray:
        mixed = (np.asarray(passage, np.uint32) * np.uint32(0x9E3779B1)) ^ (word.astype(np.uint32) * np.uint32(0x85EBCA77))
        return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(len(self.held) - 1)

    def holds(self, passage: np.ndarray | int, word: np.ndarray) -> np.ndarray:
        """Whether passages have words (numbers; those that no passage has are last, or -1)."""
        last = len(self.weight) - 1
        return self.held[self._slot(passage, word)] & (word != last) & (word >= 0)

    def run_hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a sequence of word ids where a run of a passage begins, and the passages."""
        # How many words from each place on are known without a break.
        gap = np.flatnonzero(flat < 0)
        ahead = np.concatenate([gap, [len(flat)]])[np.searchsorted(gap, np.arange(len(flat)))] - np.arange(len(flat))
        places, passages = [], []
        for k, (hashes, of, start) in self.runs.items():
            at = np.flatnonzero(ahead >= k)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(k):
                h = h * _MIX + flat[at + j].astype(np.uint64)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for x in np.flatnonzero(high > low):
                for y in range(low[x], high[x]):
                    if np.array_equal(self.sequences[of[y]][start[y] : start[y] + k], flat[at[x] : at[x] + k]):
                        places.append(at[x])
                        passages.append(of[y])
        return np.array(places, dtype=np.int64), np.array(passages, dtype=np.int64)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of padded word ids (blocks x run), passages, cosines, and whether a run is there.

        All that reach the bound and hold a run, and all that reach the least cosine. A run
        lies in the window that begins with its first word's block.
        """
        known = ids >= 0
        count = known.sum(1)
        pair = np.flatnonzero((count[:-1] + count[1:]) > 0)
        hit_w, hit_p, hit_c, hit_r = [], [], [], []
        safe = np.where(known, ids, len(self.weight) - 1)
        place, passage = self.run_hits(ids.reshape(-1))
        block = place // ids.shape[1]
        for part in np.array_split(pair, max(1, len(pair) // 8192)):
            if not len(part):
                continue
            w = np.concatenate([safe[part], safe[part + 1]], axis=1)
            u = self.words[w].sum(1)
            # Length of the part of a window's vector that the SVD leaves out.
            whole = self._square(w)
            outside = np.sqrt(np.maximum(whole - (u * u).sum(1), 0) + 1e-6 * whole)
            dot = u @ self.latent.T
            near = dot >= (COSINE * np.sqrt(whole) + 1e-9)[:, None] * self.norm[None, :]
            run = np.zeros(dot.shape, bool)
            own = np.flatnonzero((block >= part[0]) & (block <= part[-1]))
            x, y = np.searchsorted(part, block[own]), passage[own]
            bound = self.least[y] * (1 - 1e-4) - outside[x] * self.left_out[y]
            run[x, y] = dot[x, y] >= bound
            a, b = np.nonzero(near | run)
            hit_w.append(part[a])
            hit_p.append(b)
            hit_c.append(dot[a, b] / (np.sqrt(whole[a]) + 1e-9) / self.norm[b])
            hit_r.append(run[a, b])
        if not hit_w:
            return np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, bool)
        return np.concatenate(hit_w), np.concatenate(hit_p), np.concatenate(hit_c), np.concatenate(hit_r)

    def _square(self, w: np.ndarray) -> np.ndarray:
        """Squared lengths of windows' vectors. The k-th occurrence of a word adds 2k - 1 times its square."""
        s = np.sort(w, axis=1)
        again = np.ones(len(s), np.float32)
        out = self.weight[s[:, 0]] ** 2
        for j in range(1, s.shape[1]):
            again = np.where(s[:, j] == s[:, j - 1], again + 1, 1)
            out = out + self.weight[s[:, j]] ** 2 * (2 * again - 1)
        return out

    def hopeful(self, ids: np.ndarray, w: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a candidate's surroundings may hold enough for a paraphrase.

        ``low`` and ``high`` are the first block of its document and the first of the next. A
        common subsequence is no longer than the words of the surroundings that the passage has.
        """
        size = np.array([len(s) for s in self.sequences])
        out = []
        for part in np.array_split(np.arange(len(w)), max(1, len(w) // 100_000)):
            i, x = p[part], w[part]
            side = -(-size[i] // self.run)
            around = np.zeros(len(part), int)
            for k in range(-int(side.max()), int(side.max()) + 2) if len(part) else ():
                at = np.flatnonzero((x + k >= low[part]) & (x + k < high[part]) & (k >= -side) & (k <= side + 1))
                around[at] += self.holds(i[at, None], ids[x[at] + k]).sum(1)
            out.append(around >= LCS_SHARE * size[i])
        return np.concatenate(out)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(sequence: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word ids."""
    h = np.zeros(len(sequence) - k + 1, np.uint64)
    for j in range(k):
        h = h * _MIX + sequence[j : len(sequence) - k + 1 + j].astype(np.uint64)
    return h


def _masks(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(sequence):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def lcs_length(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    full = (1 << n) - 1
    row = full
    for x in other:
        m = masks.get(x)
        if m:
            y = row & m
            row = ((row + y) | (row - y)) & full
    return n - row.bit_count()


def build(passages: DataFrame, id_col: str = "item_id", text_col: str = "passage", block_words: int = BLOCK_WORDS) -> Iterator[bytes]:
    """Models of the passages, one for each block of about ``block_words`` words at most.

    Each block is decomposed by a task of its own and comes to the driver by itself, to be
    broadcast. Passages without any word are left out: nothing can hold them.
    """
    rows = passages.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    # Half a text's length is at least its number of words.
    total = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sorted(zip(pdf["i"], pdf["t"]), key=lambda x: (x[0], x[1]))
        return pd.DataFrame({"m": [pickle.dumps(Model([(int(i), words(t)) for i, t in got]))]})

    split = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for r in split.groupBy("b").applyInPandas(model, "m binary").toLocalIterator():
        yield r.m


def matches(documents: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents and the passages they may hold, with the evidence of each pair.

    Columns: doc_id, item_id, cosine (best window), lcs_share (of the passage's words, in
    order, in the surroundings of the candidate windows), answer_share, exact (holds 12
    consecutive words of the passage, or all of a shorter one). A row for every pair that
    is exact, and for every paraphrase by the thresholds above. Null and empty texts hold
    nothing; repeated rows give repeated pairs; repeated passages are items of their own;
    no passages or no documents give no rows. The scan of the documents is not shuffled.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = source.schema["k"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_share", T.DoubleType()), T.StructField("exact", T.BooleanType())])
    out = None

    def searched(models: list[bytes]) -> None:
        nonlocal out
        found = source.mapInArrow(_searcher(spark.sparkContext.broadcast(models)), schema)
        out = found if out is None else out.unionAll(found)

    models: list[bytes] = []
    for packed in build(passages):
        if models and sum(map(len, models)) + len(packed) > PASS_BYTES:
            searched(models)
            models = []
        models.append(packed)
    if models:
        searched(models)
    return out if out is not None else spark.createDataFrame([], schema)


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [m for m in map(pickle.loads, shared.value) if m.items]
        for batch in batches if models else ():
            texts, start, size = batch.column(1), 0, 0
            rows: list[list[str]] = []
            for r in range(batch.num_rows):
                rows.append(words(texts[r].as_py()))
                size += len(rows[-1])
                if size > 400_000 or r == batch.num_rows - 1:
                    for model in models:
                        get = model.vocabulary.get
                        yield from _search(model, batch.column(0).slice(start, len(rows)), [[get(w, -1) for w in x] for x in rows])
                    start, rows, size = r + 1, [], 0

    return run


def _search(model: Model, keys: pa.Array, rows: list[list[int]]) -> Iterator[pa.RecordBatch]:
    run = model.run
    # Each document is padded to whole blocks, and by one block more that parts it from the next.
    lengths = [len(r) for r in rows]
    blocks = [-(-n // run) + 1 for n in lengths]
    first = np.concatenate([[0], np.cumsum(blocks)])
    ids = np.full((int(first[-1]) + 1, run), -1, dtype=np.int32)
    flat = ids.reshape(-1)
    for r, b in zip(rows, first):
        flat[b * run : b * run + len(r)] = r
    w, p, c, run_there = model.candidates(ids)
    if not len(w):
        return
    doc = np.searchsorted(first, w, side="right") - 1
    # Windows that begin with the block between documents hold the next document's words.
    inside = w < first[doc + 1] - 1
    w, p, c, doc, run_there = w[inside], p[inside], c[inside], doc[inside], run_there[inside]
    if not len(w):
        return
    # A pair none of whose candidates can come to anything needs no closer look.
    hope = run_there | model.hopeful(ids, w, p, first[doc], first[doc + 1])
    _, pair = np.unique(doc * len(model.items) + p, return_inverse=True)
    some = np.zeros(int(pair.max()) + 1, bool)
    some[pair[hope]] = True
    best = np.full(len(some), -1.0)
    np.maximum.at(best, pair, c)
    groups: dict[int, list[int]] = {}
    for k in np.flatnonzero(hope & some[pair]).tolist():
        groups.setdefault(int(pair[k]), []).append(k)
    out: list[tuple] = []
    for g, windows in groups.items():
        d, i = int(doc[windows[0]]), int(p[windows[0]])
        base, n, size = int(first[d]) * run, lengths[d], len(model.sequences[i])
        own = flat[base : base + n]
        share = answer = 0.0
        for x in sorted({int(w[k]) for k in windows}):
            a = x * run - base
            part = own[max(0, a - size) : min(n, a + 2 * run + size)]
            part = part[model.holds(i, part)].tolist()
            if len(part) > share * size:
                share = max(share, lcs_length(model.masks[i], size, part) / size)
            if answer < 1:
                answer = max(answer, len(model.answers[i].intersection(part)) / len(model.answers[i]))
            if share == answer == 1:
                break
        exact = bool(run_there[windows].any())
        if exact or (best[g] >= COSINE and share >= LCS_SHARE and answer >= ANSWER_SHARE):
            out.append((d, model.items[i], float(best[g]), share, answer, exact))
    if out:
        d, item, cos, share, answer, exact = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(d)), pa.array(item, pa.int64()), pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.float64()), pa.array(exact, pa.bool_())],
            names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "exact"],
        )
