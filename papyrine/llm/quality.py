"""Per-document text statistics, and kinds of text by a learned rule list.

Statistics are column expressions over the whole text, evaluated in the JVM in one pass
without a shuffle. An ordered list of rules over them is induced by incremental
reduced-error pruning: each rule is grown condition by condition on one part of the
labelled documents, pruned back on the other, and kept while nearly all that
it covers there is right. The learned thresholds are exported as one SQL CASE expression.

The labelled documents are built here, from invented words in layouts of each kind,
whole or mixed with other kinds, in which case the kind with most characters is the label.
Their number is a parameter, the same whatever the size of the corpus.
"""

from __future__ import annotations

import base64
import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import computed_once

#: Labelled documents made for the induction, at most this many for each kind.
LABELLED_PER_KIND = 1500
#: A rule is kept while at least this share of what it covers on unseen rows is right.
LEAST_RIGHT = 0.9
#: Frequent function words of the four languages of the corpus, fixed values.
COMMON = tuple(
    sorted(
        set(
            "the of and in to with for was were by from that is a an be on at as not no could may which because or this these had has have been their its it than but when while".split()
            + "der die das und im bei den mit von war waren nicht ist auf ein eine einer als dem des zu für nach wurde wurden sich aus noch am es an".split()
            + "les le la de du et en par dans que été un une pour était au aux ce cette qui sur pas avec chez est il a ont plus sont à".split()
            + "los las el y se con por para una del fue fueron como su lo al más son entre muestras no es este".split()
        )
    )
)
LONGEST_COMMON = max(map(len, COMMON))
#: Blanks besides the usual ones, and marks that belong to ordinary writing.
BLANKS, QUOTES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\x85", "–—•‘’“”"
BLANK = f"[\\s{BLANKS}]+"
#: Unaccented vowels tell letters drawn at random in every language here, and their class is
#: a bitmap for the engine.
VOWELS = "aeiouy"


#: Patterns over whole texts, each read once by the regular-expression engine.
PATTERNS = {
    "cells": r"(?m)^(?:[^|\n]*\|[^|\n]*\||[^\t\n]*\t[^\t\n]*\t|[^;\n]*;[^;\n]*;|(?:[^,\n]|,(?=[ \t]))*+,(?!\s)(?:[^,\n]|,(?=[ \t]))*+,(?!\s)(?:[^,\n]|,(?=[ \t]))*+,|[ ]*[^ \n]+(?: [^ \n]+)*+ {2,}[^ \n]+(?: [^ \n]+)*+ {2,}[^ \n])[^\n]*",
    "short": r"(?m)^[ \t]*[^\s][^\n]{0,58}(?<![.!?:\s])[ \t\r]*$",
    "marked": r"(?m)^[ \t]*(?:[-*•·–+]|\(?[0-9a-zA-Z]{1,3}[.)]|\[[ xX]?\])[ \t][^\n]*$",
    "ends": r"(?m)[.!?][ \t\r]*$",
    "lines": r"[^\s][^\n]*",
    "not_digits": r"\P{Nd}+",
    "not_odd": r"[\p{L}\p{M}\p{Nd}\s.,;:!?'\"()%/|\-\[\]<>&]+",
    "not_vowels": f"[^{VOWELS}{VOWELS.upper()}]+",
    "not_letters": r"[^\p{L}]+",
}


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and a column for each statistic, a row for each row of ``df``.

    Words are parted by blanks of any kind (BLANK), which are no symbols. Shares lie between 0 and 1 and are 0 where there is nothing to share; a null, empty or
    blank text has zeros only. Texts of any length are measured whole, by patterns over the
    text as it is, so that no array of lines or characters is built; only the two named
    columns are read.
    """
    d = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    count = lambda c, p: F.regexp_count(c, F.lit(PATTERNS[p]))
    left = lambda c, p: F.length(F.regexp_replace(c, PATTERNS[p], ""))
    t = F.col("_t")
    # Classes beyond the bitmap are slow; the few texts that need them are told by a search.
    has = lambda marks: (F.octet_length(t) > F.length(t)) & functools.reduce(lambda a, b: a | b, [t.contains(m) for m in marks])
    marks = lambda m: F.when(has(m), F.regexp_count(t, F.lit(f"[{m}]"))).otherwise(0)
    words = F.filter(F.when(has(BLANKS), F.split(t, BLANK)).otherwise(F.split(t, r"\s+")), lambda x: x != "")
    d = d.withColumns({"_rest": F.when(t.contains("|") | t.contains("\t") | t.contains(";") | t.contains("  ") | t.rlike(r",\S"), F.regexp_replace(t, PATTERNS["cells"], "")).otherwise(t), "_w": words, "n_chars": F.length("_t")})
    rest, w = F.col("_rest"), F.col("_w")
    solid = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    d = d.withColumns(
        {
            "n_words": F.size("_w"), "_distinct": F.size(F.array_distinct("_w")), "n_lines": count(t, "lines"), "_restn": F.length(rest),
            "_letters": left(t, "not_letters"), "_digits": left(t, "not_digits"), "_odd": left(t, "not_odd") - marks(QUOTES) - marks(BLANKS), "_vowels": left(t, "not_vowels"),
            "_solid": solid(w), "_common": F.size(F.filter(w, lambda x: (F.length(x) <= LONGEST_COMMON) & F.lower(x).isin(*COMMON))),
            "_single": F.size(F.filter(w, lambda x: F.length(x) == 1)), "_long": solid(F.filter(w, lambda x: F.length(x) > 24)),
            "_pairs": F.size(F.filter(w, lambda x: (F.length(x) == 2) & x.rlike("^[0-9a-f]{2}$"))) * 2, "_ends": count(t, "ends"),
            "_short": F.length(rest) - left(rest, "short"), "_marked": F.length(rest) - left(rest, "marked"),
        }
    ).withColumns({"_measured": F.greatest(F.col("n_chars") - F.col("n_lines") + 1, F.lit(0)), "_cells": F.col("n_chars") - F.col("_restn")})
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.col(a) / F.col(b), F.lit(1.0))).otherwise(F.lit(0.0))
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        F.col("_id").alias(id_col), F.col("n_chars").cast("long"), F.col("n_words").cast("long"), F.col("n_lines").cast("long"),
        mean("_solid", "n_words").alias("mean_word_length"), mean("_measured", "n_lines").alias("mean_line_length"),
        share("_letters", "_solid").alias("letter_share"), share("_digits", "_solid").alias("digit_share"), share("_odd", "_solid").alias("symbol_share"),
        share("_vowels", "_letters").alias("vowel_share"), share("_common", "n_words").alias("common_word_share"), share("_distinct", "n_words").alias("distinct_word_share"),
        F.col("_distinct").cast("long").alias("distinct_words"),
        share("_single", "n_words").alias("single_char_share"), share("_long", "_solid").alias("long_token_share"), share("_pairs", "_solid").alias("code_token_share"),
        share("_ends", "n_lines").alias("end_punctuation_share"), share("_cells", "_measured").alias("cell_share"), share("_short", "_measured").alias("short_line_share"),
        share("_marked", "_measured").alias("marked_share"),
    )


#: Statistics that rules may use. Those that depend on a text's length (other counts)
#: or on the lexicon's word lengths don't tell kinds apart and aren't offered.
FEATURES = (
    "letter_share digit_share symbol_share vowel_share common_word_share distinct_words distinct_word_share single_char_share "
    "long_token_share code_token_share end_punctuation_share cell_share short_line_share marked_share"
).split()

# ---------------------------------------------------------------- labelled documents


class Maker:
    """Makes labelled documents from invented words."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        onset, core, coda = "b c d f g h l m n p r s t v br cl dr gr pl pr st tr sp ch sch str thr".split(), "a e i o u a e i o u ai ea io ou ie".split(), ["", "", "n", "r", "s", "l", "t", "nd", "st", "m"]
        heavy = ["n", "rk", "st", "ng", "cht", "ts", "lls", "nds", "rth", "ck"]

        def one(codas: list[str]) -> str:
            return "".join(self.r.choice(onset) + self.r.choice(core) + self.r.choice(codas) for _ in range(self.r.randint(2, 4)))

        # Lexica from rich in vowels to rich in consonants; each document draws from one.
        self.lexica = [[one(coda if self.r.random() > k / 5 else heavy) for _ in range(400)] for k in range(6)]
        self.lexicon = self.lexica[0]
        en = "the of and in to with for was were by from that is a be on at as not no could may which because or".split()
        de = "der die das und im bei den mit von war waren nicht ist auf ein eine als dem zu für nach wurde sich".split()
        fr = "les le la de du et en par dans que été un une pour était au ce cette qui sur pas avec chez".split()
        es = "los las el y se con por para una del fue como su que en de la un no más entre".split()
        self.languages = [en, en, de, fr, es]

    def word(self) -> str:
        return self.r.choice(self.lexicon)

    def term(self, most: int = 3) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, most)))

    def number(self) -> str:
        return self.r.choice([str(self.r.randint(1, 400)), f"{self.r.uniform(0, 100):.1f}", f"{self.r.uniform(0, 100):.1f}%"])

    def sentence(self, common: list[str], rate: float, numbers: float) -> str:
        n, out = self.r.randint(3, 26), []
        while len(out) < n:
            out.append(self.r.choice(common) if self.r.random() < rate else self.number() if self.r.random() < numbers else self.word())
        return " ".join(out).capitalize() + self.r.choice([".", ".", ".", "?", ")."])

    def prose(self, size: int) -> str:
        common, out = self.r.choice(self.languages), []
        rate, numbers = self.r.triangular(0.14, 0.5, 0.34), self.r.choice([0, 0.03, 0.1, 0.25])
        while sum(map(len, out)) < size:
            out.append(self.sentence(common, rate, numbers))
        layout = self.style = self.r.choice((0, 1, 2, 2, 2, 3))
        if layout == 0:
            text = " ".join(out)
        elif layout == 1:
            text = "\n".join(out)
        elif layout == 2:
            text = self.wrap(" ".join(out), self.r.randint(45, 90))
        else:
            text = "".join(s + self.r.choice([" ", " ", "\n\n"]) for s in out).strip()
        if self.r.random() < 0.15:
            # Blanks as careless extraction leaves them.
            text = "".join(self.r.choice(["  ", " ", "   "]) if c == " " and self.r.random() < 0.7 else c for c in text)
        if self.r.random() < 0.15:
            text = "# " + self.term(6) + "\n\n" + text
        if self.r.random() < 0.1:
            # A token without blanks, an address or a sequence, shorter than the prose.
            text += " " + "".join(self.r.choice(self.r.choice(["x", "ACGT", "acgnprtu/._-0123456789"])) for _ in range(int(len(text) * self.r.uniform(0.1, 0.9))))
        if self.r.random() < 0.15:
            text = text.upper()
        if self.r.random() < 0.1:
            some = self.r.choice("¶�~¤ ")
            text = "".join(some if c.isalpha() and self.r.random() < 0.04 else c for c in text)
        return text

    @staticmethod
    def wrap(text: str, width: int) -> str:
        import textwrap

        return textwrap.fill(text, width)

    def entry(self, common: float, comma: float, number: float) -> str:
        e = self.term()
        if self.r.random() < common:
            e = self.r.choice(self.r.choice(self.languages)) + " " + e
        if self.r.random() < comma:
            e += ", " + self.term(2)
        if self.r.random() < number:
            e += f" ({self.r.randint(1, 99)})"
        return e

    def list(self, size: int) -> str:
        style, out, n = self.r.randrange(9), [], 0
        self.style = style
        habits = [self.r.choice([0, 0, 0.25, 0.5]) for _ in range(3)]
        if self.r.random() < 0.6:
            out.append(self.r.choice([self.term().capitalize(), f"{self.term().capitalize()} {self.number()}:"]))
        while sum(map(len, out)) < size or n < 4:
            e, n = self.entry(*habits), n + 1
            if style == 8:
                e = ", ".join([e, *[str(self.r.randint(1, 400)) for _ in range(self.r.randint(1, 5))]])
            elif style == 7:
                e = e.capitalize()
            elif style < 6:
                e = [f"- {e}", f"* {e}", f"• {e}", f"{n}. {e}", f"({chr(97 + n % 26)}) {e}", f"[{self.r.choice(' x')}] {e}"][style]
            out.append(e)
        return "\n".join(out)

    def table(self, size: int) -> str:
        style, columns, out = self.r.randrange(7), self.r.randint(4, 7), []
        self.style = style
        most = self.r.choice([1, 2, 2])
        names = [self.term(most) for _ in range(columns)]
        rows, words = [names], self.r.choice([0, 0, 0.3, 0.8])
        while sum(len(c) + 2 for row in rows for c in row) < size or len(rows) < 4:
            rows.append([self.term(most), *[self.term(most) if self.r.random() < words else self.r.choice([self.number(), self.number(), self.number(), "", "-", "n.s."]) for _ in range(columns - 1)]])
        if style == 0:
            out = ["| " + " | ".join(row) + " |" for row in rows]
            out.insert(1, "| " + " | ".join("---" for _ in names) + " |")
        elif style == 1:
            out = [",".join(row) for row in rows]
        elif style == 2:
            out = [";".join(f'"{c}"' for c in row) for row in rows]
        elif style == 3:
            out = ["\t".join(row) for row in rows]
        elif style == 4:
            out = ["".join(c[:18].ljust(20) for c in row).rstrip() for row in rows]
        elif style == 5:
            out = ["".join(f"{self.r.uniform(0, 500):10.2f}" for _ in range(columns)) for _ in rows]
        else:
            out = [";".join(row) for row in rows]
        if self.r.random() < 0.4:
            out.insert(0, f"Table {self.r.randint(1, 9)}. {self.term(8).capitalize()}")
        return "\n".join(out)

    def junk(self, size: int) -> str:
        r, style = self.r, self.r.randrange(10)
        self.style = style
        pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
        if style == 0:
            raw = base64.b64encode(r.randbytes(size * 3 // 4)).decode()
            return "\n".join(raw[i : i + 76] for i in range(0, len(raw), 76))
        if style == 1:
            return "\n".join(f"{16 * i:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for i in range(max(2, size // 58)))[: -r.randint(1, 40)]
        if style == 2:
            return "".join(pick("!#$%&*+-./:;<=>?@[]^_{|}~\\", r.randint(1, 30)) + r.choice(" \n") for _ in range(max(4, size // 15)))
        if style == 3:
            return "\n".join(pick("ABCDEF", 1) + pick("0123456789", r.randint(1, 5)) + pick("0123456789_$%", r.randint(8, 50)) for _ in range(max(3, size // 30)))
        if style == 4:
            return " ".join(pick("bcdfghjklmnpqrstvwxz", r.randint(2, 12)) for _ in range(max(8, size // 8)))
        if style == 5:
            alphabet = "".join(r.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789|.,:;~'", r.randint(12, 60))) + "|" * r.randint(0, 3)
            return " ".join(pick(alphabet, 1) for _ in range(max(30, size // 2)))
        if style == 6:
            return r.choice([" ", "\n", ", "]).join([r.choice([self.word(), self.term(3), self.term(3), self.term(4), "null", "nan", "xxx", "test"])] * max(12, size // 9))
        if style == 7:
            level = r.uniform(0.35, 0.7)
            text = self.prose(size)
            self.style = style
            return "".join(pick("�¤€¶Ã¿âé", 1) if r.random() < level and c != " " else c for c in text)
        if style == 8:
            return " ".join(pick("ACGT" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz0123456789", r.randint(30, 120)) for _ in range(max(1, size // 80)))
        return pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", size)

    def document(self, kind: str) -> tuple[str, str]:
        """A text and its kind with its style, as in ``list.3``."""
        make: dict[str, Callable[[int], str]] = {"prose": self.prose, "list": self.list, "table": self.table, "junk": self.junk}
        size = int(self.r.triangular(20, 2600, 300)) if self.r.random() < 0.75 else self.r.randint(15, 120)
        self.lexicon = self.r.choice(self.lexica)
        if self.r.random() < 0.15:
            # Long texts of few words, as templates bring.
            self.lexicon, size = self.lexicon[:30], size * 6
        text = make[kind](size)
        style = self.style
        if self.r.random() < 0.3 and kind != "junk":
            # A part of another kind, clearly smaller or clearly larger than this one.
            other = self.r.choice([k for k in ("prose", "list", "table") if k != kind])
            factor = self.r.choice([0.15, 0.3, 0.5, 1.8])
            part = make[other](int(len(text) * factor))
            if 0.75 < len(part) / len(text) < 1.34:
                return text, f"{kind}.{style}"
            kind, style = (other, self.style) if len(part) > len(text) else (kind, style)
            text = "\n".join([part, text] if self.r.random() < 0.5 else [text, part])
        return text, f"{kind}.{style}"


def labelled(per_kind: int = LABELLED_PER_KIND, seed: int = 11) -> list[tuple[str, str]]:
    """Made documents with their kind."""
    maker = Maker(seed)
    return [maker.document(k) for k in ("prose", "list", "table", "junk") for _ in range(per_kind)]


# ---------------------------------------------------------------- rule induction

Condition = tuple[int, str, float]


def _holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, v in rule:
        ok &= x[:, f] <= v if op == "<=" else x[:, f] > v
    return ok


def _grow(x: np.ndarray, y: np.ndarray, places: list[np.ndarray], most: int = 5) -> list[Condition]:
    """Add the condition of the highest FOIL gain until no wrong row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        if not n or not p:
            break
        base, best, choice = np.log2(p / (p + n)), 1e-9, None
        for f, cuts in enumerate(places):
            v, good = x[inside, f], y[inside]
            below = v[:, None] <= cuts[None, :]
            p1, n1 = (below & good[:, None]).sum(0), (below & ~good[:, None]).sum(0)
            for op, a, b in (("<=", p1, n1), (">", p - p1, n - n1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = gain[k], (f, op, float(cuts[k]))
        if choice is None:
            break
        # The threshold goes to the middle of the gap that it lies in.
        f, op, v = choice
        below, above = (y, ~y) if op == "<=" else (~y, y)
        low, high = x[inside & below & (x[:, f] <= v), f], x[inside & above & (x[:, f] > v), f]
        if len(low) and len(high) and low.max() < high.min():
            choice = (f, op, float((low.max() + high.min()) / 2))
        rule.append(choice)
        inside &= _holds(x, [choice])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, rule: list[Condition]) -> list[Condition]:
    """The rule without the final conditions whose loss doesn't hurt on unseen rows."""
    best, score = rule, -2.0
    for k in range(len(rule), 0, -1):
        c = _holds(x, rule[:k])
        p, n = int((c & y).sum()), int((c & ~y).sum())
        s = (p - n) / (p + n) if p + n else -1.0
        if s >= score:
            best, score = rule[:k], s
    return best


def induce(x: np.ndarray, kinds: np.ndarray, order: tuple[str, ...] = ("junk", "table", "list"), seed: int = 5, most_rules: int = 4) -> list[tuple[list[Condition], str]]:
    """Ordered rules (conditions, kind); what no rule covers is of the remaining kind.

    ``kinds`` are kinds with styles. Rules are learned style by style, so that each tells
    what makes its style; rows of the kind's other styles are neither right nor wrong.
    """
    rng = np.random.default_rng(seed)
    places = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129)[1:-1])) for f in range(x.shape[1])]
    rules: list[tuple[list[Condition], str]] = []
    left = np.ones(len(x), bool)
    family = np.array([k.split(".")[0] for k in kinds])
    for kind in order:
        for style in sorted(set(kinds[family == kind])):
            for _ in range(most_rules):
                y = kinds == style
                rows = rng.permutation(np.flatnonzero(left & (y | (family != kind))))
                if y[rows].sum() < 6:
                    break
                third = len(rows) // 3
                grow, prune = rows[third:], rows[:third]
                rule = _grow(x[grow], y[grow], places)
                if not rule:
                    break
                rule = _prune(x[prune], y[prune], rule)
                c = _holds(x[prune], rule)
                p, n = int((c & y[prune]).sum()), int((c & ~y[prune]).sum())
                if p < LEAST_RIGHT * (p + n) or p < 2:
                    break
                rules.append((rule, kind))
                left &= ~_holds(x, rule)
    return rules


def to_sql(rules: list[tuple[list[Condition], str]], names: list[str] = FEATURES, other: str = "prose") -> str:
    """The rule list as one CASE expression over the statistics."""
    whens = [" and ".join(f"{names[f]} {op} {v!r}D" for f, op, v in rule) for rule, _ in rules]
    return "case when n_words = 0 then cast(null as string) " + " ".join(f"when {w} then '{k}'" for w, (_, k) in zip(whens, rules)) + f" else '{other}' end"


def learn(spark: SparkSession, per_kind: int = LABELLED_PER_KIND, seed: int = 11) -> tuple[str, list[tuple[list[Condition], str]]]:
    """The CASE expression learned from made documents, measured by the same expressions.

    Both depend on the parameters only, so they are learned once in a process.
    """
    if (per_kind, seed) in _LEARNED:
        return _LEARNED[per_kind, seed]
    made = labelled(per_kind, seed)
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(made)], "doc_id long, text string, kind string")
    got = {r[0]: r[1:] for r in with_statistics(df).select("doc_id", *[F.col(f).cast("double") for f in FEATURES]).collect()}
    x = np.array([got[i] for i in range(len(made))])
    rules = induce(x, np.array([k for _, k in made]))
    _LEARNED[per_kind, seed] = to_sql(rules), rules
    return _LEARNED[per_kind, seed]


_LEARNED: dict[tuple[int, int], tuple[str, list]] = {}


def classified(df: DataFrame, case: str | None = None) -> DataFrame:
    """Statistics and ``kind``: prose, list, table or junk; null for texts without words."""
    case = learn(df.sparkSession)[0] if case is None else case
    measured = with_statistics(df)
    # A filter on the kind must not be pushed below the statistics, which the planner would
    # then write out, and compute, again for every condition of every rule.
    return computed_once(measured).withColumn("kind", F.expr(case))
