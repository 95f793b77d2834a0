"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes look-alike letters and digits or signs put for letters, character for character, so that a match can be checked
against the text as written: a word counts if it starts and ends at a word's edge, a stem (written with a star) if it starts a
longer word. A match inside an exception phrase doesn't count. The weighted sum of matches is normalised by the text's
length and turned into a probability.

The lexicon and the two numbers of that last step are learned from labelled rows: words and stems are chosen by the likelihood
ratio between toxic and other texts, the strongest of each chain of prefixes, and weigh their log-odds less one standard
error. Defined results: a null text is the empty text; a null id takes no part in the fit and has a score; texts of any length are read whole; of terms that start one another and tie the longest stays; repeated rows repeat their score; an empty table gives an empty result; all columns of
the table are kept, the new one gives way to one of its name. At most ``max_fit_rows`` labelled rows are used, those whose ids hash lowest; scoring takes every row and whole text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free, keep, whole

# Letters that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ſ": "s",
}
FOR_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
EXCEPTIONS = ("trash can", "trash bin", "trash day", "class clown", "clown fish", "clown car", "sore loser board", "idiot proof", "idiot light", "scum line", "pond scum")
SIGN = re.compile("[" + re.escape("".join(FOR_LETTER)) + "]")
TOKEN = re.compile(r"[^\W_]+")
#: Lengths of words and of stems that can be learned.
WORD_SIZES, STEM_SIZES = range(3, 41), range(4, 13)


def letter_fold() -> dict[int, str]:
    """One character for one: lower case, look-alikes, full-width forms, and mathematical letters by their position in blocks of 26."""
    table = {ord(k): v for k, v in LOOK_ALIKE.items()} | {ord(k.upper()): v for k, v in LOOK_ALIKE.items() if len(k.upper()) == 1 and not k.upper().isascii()}
    table |= {0xFF21 + i + 32 * low: chr(97 + i) for i in range(26) for low in (0, 1)}
    table |= {0x1D400 + i: chr(97 + i % 26) for i in range(26 * 26)}
    return table


LETTERS = letter_fold()
SIGNS = {ord(k): v for k, v in FOR_LETTER.items()}


def fold(text: str) -> tuple[str, str]:
    """The text with letters folded, and with digits and signs too (the same one if it has none). Both have the text's length."""
    low = text.lower()
    plain = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    plain = plain if plain.isascii() else plain.translate(LETTERS)
    return plain, plain.translate(SIGNS) if SIGN.search(plain) else plain


def terms_of(text: str) -> set[str]:
    """Folded words of a text, and the stems of longer ones with a star."""
    plain, signs = fold(text)
    words = {w for w in {*TOKEN.findall(plain), *TOKEN.findall(signs)} if len(w) in WORD_SIZES}
    return words | {f"{w[:n]}*" for w in words for n in STEM_SIZES if n < len(w)}


@dataclass
class Lexicon:
    """weights: of folded terms. A text's score is the logistic value of slope times its strength, plus offset."""

    weights: dict[str, float]
    slope: float = 1.0
    offset: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and term of each match that counts."""
        if self.machine is None:
            entries: dict[str, list[str | None]] = defaultdict(list)
            for term in self.weights:
                entries[term.removesuffix("*")].append(term)
            for phrase in self.exceptions:
                entries[fold(phrase)[1]].append(None)
            self.machine = ahocorasick.Automaton()
            for letters, terms in entries.items():
                self.machine.add_word(letters, (len(letters), terms))
            self.machine.make_automaton()
        if not self.weights:
            return []
        plain, signs = fold(text)
        hits, excused = set(), []
        for look in (plain, signs) if signs is not plain else (plain,):
            for last, (size, terms) in self.machine.iter(look):
                start, end = last + 1 - size, last + 1
                # An edge is judged as written: a sign or digit beside a match is no letter.
                if start and plain[start - 1].isalpha():
                    continue
                whole_word = end == len(plain) or not plain[end].isalpha()
                for term in terms:
                    if term is not None and term.endswith("*"):
                        if look[end : end + 1].isalnum():
                            hits.add((start, end, term))
                    elif whole_word and term is not None:
                        hits.add((start, end, term))
                    elif whole_word:
                        excused.append((start, end))
        return [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in excused)]

    def strength(self, text: str) -> float:
        """Weights of the matches over the logarithm of the number of words."""
        hits = self.found(text)
        return sum(self.weights[t] for _, _, t in hits) / math.log2(2 + text.count(" ")) if hits else 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.strength(text) + self.offset))))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on one column, by Newton's method with a small ridge."""
    w = np.zeros(2)
    rows = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (y - p) - np.array([1e-2, 0]) * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0)), float(w[1])


def held_out(id_col: str) -> Column:
    """The fold that learning never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def strongest(found: list[tuple[str, float, float]], max_terms: int | None = None) -> dict[str, float]:
    """Weights of terms given as (term, evidence, weight): of terms that start one another the one with the most evidence stays, the longest of equals."""
    chosen: dict[str, float] = {}
    for term, _, weight in sorted(found, key=lambda f: (-f[1], -len(f[0].removesuffix("*")), f[0])):
        letters = term.removesuffix("*")
        if (max_terms is None or len(chosen) < max_terms) and not any(letters.startswith(c.removesuffix("*")) or c.startswith(letters) for c in chosen):
            chosen[term] = weight
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_fit_rows: int = 20_000, least_share: float = 0.02, least_deviation: float = 4.0, prior: float = 0.05,
) -> Lexicon:
    """Learn a lexicon from labelled rows outside the held-out fold.

    A term has to occur in a share of the toxic texts (three at least), and its likelihood ratio has to be as unlikely by chance as
    least_deviation standard deviations, since many terms are tried. Where there are no toxic or no other rows to learn from, nothing can be
    told apart: the lexicon is empty and ``prior`` is every text's score. A document labelled more than once counts once, as toxic if any label says so;
    rows of documents that repeat an id count each. Labels of unknown ids and null labels are left out.
    """
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), (F.col(label_col) > 0).cast("int").alias("label"))
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label"))
    # Bounded by max_fit_rows rows of 12 bytes, so it can be broadcast.
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(max_fit_rows)
    # Written once: the passes below read the chosen texts only, not the whole table again.
    rows = keep(docs.select(F.col(id_col).cast("long").alias("key"), whole(text_col).alias("text")).join(F.broadcast(chosen), "key").select("label", "text"))

    def terms(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def counted() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "other", "toxic"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                for term in terms_of(text):
                    counts.setdefault(term, [0, 0])[label > 0] += 1
                if len(counts) > most:
                    yield counted()
        yield counted()

    total = rows.agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count_if(F.col("label") <= 0).alias("other")).first()
    if not total["toxic"] or not total["other"]:
        return Lexicon({}, 0.0, math.log(prior / (1 - prior)))
    counted = rows.mapInArrow(terms, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    often = max(3.0, least_share * total["toxic"])
    counted = counted.where((F.col("toxic") >= often) & (F.col("toxic") * total["other"] > F.col("other") * total["toxic"]))
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    share = (a + b) / (total["toxic"] + total["other"])
    excess = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    evidence = F.lit(0.0)
    for seen, n in ((a, total["toxic"]), (b, total["other"])):
        evidence += 2 * (excess(seen, share * n) + excess(n - seen, (1 - share) * n))
    p, q, r, t = a + 0.5, b + 0.5, total["toxic"] + 0.5 - a, total["other"] + 0.5 - b
    weight = F.log(p * t / (q * r)) - F.sqrt(1 / p + 1 / q + 1 / r + 1 / t)
    found = counted.select("term", evidence.alias("evidence"), weight.alias("weight")).where((F.col("evidence") >= least_deviation**2) & (F.col("weight") > 0))
    # All that pass: terms in a share of at most max_fit_rows rows, so their number has a bound of its own.
    lexicon = Lexicon(strongest([(f["term"], f["evidence"], f["weight"]) for f in found.collect()]))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("label")], ["x", "label"])

    # At most max_fit_rows pairs of numbers.
    pairs = rows.mapInArrow(strengths, "x double, label int").collect()
    lexicon.slope, lexicon.offset = platt(np.array([r["x"] for r in pairs]), np.array([float(r["label"] > 0) for r in pairs]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column more, its name led by underscores where docs has one of that name; a null text scores as an empty one. No shuffle."""
    text, score_col = free(docs, "text_to_score", score_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([lexicon.score(t) for t in batch.column(text).to_pylist()], pa.float64())
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], [*names, score_col])

    return docs.withColumn(text, whole(text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    (name,) = free(docs, "toxicity")
    return score(docs, fit(docs, labels, **how), how.get("text_col", "text"), name).where(F.col(name) < threshold).drop(name)
