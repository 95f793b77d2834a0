"""License scans: winnowed fingerprints of templates pick candidates, banded alignment decides.

Templates are cut into words. Of every ``WINNOW`` neighbouring k-grams the one with the smallest hash goes into the inverted
index (gram to template and place), so any stretch of k + WINNOW - 1 words copied from a template holds an indexed gram (of templates shorter
than that each gram is indexed). A document's grams are looked up in the index; hits of one template whose diagonals lie within the band
of one another form a group, long templates need two hits, and alignment within the band around all of the group's diagonals counts the
template's words that occur in order, and where they start and end. Words that a match has are taken out and the rest of the group is aligned again,
so each repeat of a notice is found.

Templates are a constant of the program (or a parameter), so the index is bounded and goes to each task with the code. No shuffle.

Defined results: a null or empty text has no licenses; of overlapping matches the one of most words counts, then that of the best coverage, then the
first name; a null id stays null; texts of any length are read whole; repeated rows repeat their result; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole
from .license_texts import TEMPLATES

GRAM, WINNOW, BAND = 3, 4, 8
#: Diagonals of one group are at most so far apart, and templates of at least so many words need two hits.
SPREAD, LONG = 32, 20
WORD = re.compile(r"[^\W_]+")


class TemplateIndex:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names = [(name, text) for name, texts in templates.items() for text in texts]
        cut = [WORD.findall(text.lower()) for _, text in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for words in cut for w in words}))}
        self.words = [np.array([self.number[w] for w in words]) for words in cut]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, numbers in enumerate(self.words):
            for gram, at in winnow(self.grams(numbers)):
                self.places[gram].append((t, at))
        self.indexed = np.array(sorted(self.places), np.int64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Each GRAM neighbouring words as one number; one that has an unknown word is -1."""
        n = len(numbers) - GRAM + 1
        if n < 1:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(GRAM):
            out = out * (len(self.number) + 1) + numbers[i : i + n]
            known &= numbers[i : i + n] > 0
        return np.where(known, out, -1)

    def scan(self, text: str, least: float) -> list[tuple[str, float, int, int]]:
        """Name, coverage, first and last character (exclusive) of each match, by place."""
        words = WORD.findall(text.lower())
        numbers = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        grams = self.grams(numbers)
        hits = np.flatnonzero(np.isin(grams, self.indexed))
        if not len(hits):
            return []
        diagonals: dict[int, set[int]] = defaultdict(set)
        for at in hits:
            for t, place in self.places[int(grams[at])]:
                diagonals[t].add((int(at) - place, int(at)))
        spans, out = None, []
        for t, found in sorted(diagonals.items()):
            words_of = self.words[t]
            for group in grouped(sorted(found)):
                if len(words_of) >= LONG and len(group) < 2:
                    continue
                low, high = group[0][0] - BAND, group[-1][0] + BAND
                start = max(0, low)
                part = numbers[start : high + len(words_of)].copy()
                while True:
                    matched, first, last, _ = align(words_of, part, low - start, high - start)
                    coverage = matched / len(words_of)
                    if coverage < least:
                        break
                    part[first : last + 1] = -1
                    if spans is None:
                        spans = [m.span() for m in WORD.finditer(text)]
                        if len(spans) != len(words):
                            spans = [m.span() for m in WORD.finditer(text.lower())]
                    out.append((self.names[t][0], coverage, spans[start + first][0], spans[start + last][1], matched))
        return [m[:4] for m in best_spans(out)]


def grouped(found: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted (diagonal, place) pairs, cut where diagonals are more than the band apart or the group would spread too far."""
    group: list[tuple[int, int]] = []
    for pair in found:
        if group and (pair[0] - group[-1][0] > BAND or pair[0] - group[0][0] > SPREAD):
            yield group
            group = []
        group.append(pair)
    if group:
        yield group


def winnow(grams: np.ndarray) -> list[tuple[int, int]]:
    """The gram with the smallest hash of every WINNOW neighbours, the last of equal ones; all of them where there are few."""
    hashes = [zlib.crc32(int(g).to_bytes(8, "little", signed=True)) for g in grams]
    if len(hashes) < 3 * WINNOW:
        return [(int(g), i) for i, g in enumerate(grams)]
    chosen = {min(range(i, i + WINNOW), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - WINNOW + 1)}
    return [(int(grams[i]), i) for i in sorted(chosen)]


def align(template: np.ndarray, numbers: np.ndarray, low: int, high: int) -> tuple[int, int, int, float]:
    """Words matched in order between two diagonals, with a small charge for words skipped between, the first and last place matched, and the score.

    A row of the table is computed at once: along it a charge for each skipped word makes the best score a running maximum.
    """
    width, charge = high - low + 1, 0.3
    steps = charge * np.arange(width)
    score, count = np.zeros(width), np.zeros(width, np.int64)
    first, last = np.full(width, -1), np.full(width, -1)
    best, n = (0.0, 0, 0, 0), len(numbers)
    padded = np.full(len(template) + width, -2, np.int64)
    begin, end = max(0, low), min(n, low + len(padded))
    if begin >= end:
        return 0, 0, 0, 0.0
    padded[begin - low : end - low] = numbers[begin:end]
    for i, word in enumerate(template):
        hit = padded[i : i + width] == word
        at = i + low + np.arange(width)
        started = np.where(first < 0, at, first)
        new = np.where(hit, score + 1.0, score - charge)
        new_count, new_first, new_last = count + hit, np.where(hit, started, first), np.where(hit, at, last)
        # A template word left out: the cell to the right of the row before.
        up = np.append(score[1:], -np.inf) - charge
        take = up > new
        shift = lambda x: np.append(x[1:], x[-1])
        new, new_count, new_first, new_last = np.where(take, up, new), np.where(take, shift(count), new_count), np.where(take, shift(first), new_first), np.where(take, shift(last), new_last)
        # Words of the document left out: from the best cell to the left, less a charge for each.
        ahead = new + steps
        peak = np.maximum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead >= peak, np.arange(width), 0))
        better = peak - steps > new
        pick = np.where(better, source, np.arange(width))
        new, new_count, new_first, new_last = np.where(better, peak - steps, new), new_count[pick], new_first[pick], new_last[pick]
        dead = new <= 0
        score, count = np.where(dead, 0.0, new), np.where(dead, 0, new_count)
        first, last = np.where(dead, -1, new_first), np.where(dead, -1, new_last)
        top = int(np.argmax(score))
        if score[top] > best[0] + 1e-9:
            best = (float(score[top]), int(count[top]), int(first[top]), int(last[top]))
    return best[1], best[2], best[3], best[0]


def best_spans(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Of overlapping matches the one of most words, then of the best coverage, then of the first name."""
    out: list[tuple[str, float, int, int, int]] = []
    for match in sorted(set(found), key=lambda m: (-m[4], -m[1], m[0], m[2])):
        if all(match[3] <= o[2] or o[3] <= match[2] for o in out):
            out.append(match)
    return sorted(out, key=lambda m: m[2])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, n_matches, license (names, sorted, joined by commas), coverage (the best, 0 for none), spans (license, coverage, first, last)."""
    templates = templates or TEMPLATES
    schema = "id long, n_matches long, license string, coverage double, spans array<struct<license:string,coverage:double,first:long,last:long>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in batches:
            found = [index.scan(t, least) for t in batch.column("text").to_pylist()]
            spans = [[dict(zip(("license", "coverage", "first", "last"), m)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()), pa.array([max((m[1] for m in f), default=0.0) for f in found], pa.float64()), pa.array(spans, kind)], [c.split()[0] for c in ("id", "n_matches", "license", "coverage", "spans")])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
