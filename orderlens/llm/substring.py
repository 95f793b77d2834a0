"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``window`` consecutive words. A document's reference are the documents of smaller ids, cut into blocks. A block indexes its
windows, each by the smallest place (document, word) that has it, and texts are factored against it greedily: at the first word whose window
the block has, the factor follows the reference word by word as long as the texts agree, and parsing goes on behind it. A
factor names its reference (document, word) and is at least a window long. Both texts are compared over the whole factor, its ends included,
so no hash decides. Touching factors of one reference and offset are joined over blocks, and of overlapping ones a document keeps those that
reach furthest. The words of all factors are removed; they are exactly the words of windows that a smaller document has.

Parsing each document against each block of whole texts would be quadratic, so blocks hold what can be shared only. The anchor of a
window is the smallest hash among its ``gram``-word grams; equal windows have equal anchors, and neighbouring windows mostly share
theirs, so one in about 22 words is an anchor. Only windows whose anchor is in two documents are indexed, and blocks are of two kinds: first
the documents of a batch are each other's reference, so a passage that a third of all rows share sends one run of words per batch;
then the runs that are left meet by anchor. Of an anchor with more than ``hot_entries`` runs (a common phrase in many contexts)
the windows are dealt by their hashes and find their reference by a smallest place that is combined before the shuffle; 192 bits name a window there.

Defined results: a null text is the empty text; a null id counts as larger than all others; rows with one id never remove each other's words;
documents under a window stay as they are; repeated rows repeat their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, whole

LAST = 2**63 - 1
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of size values, from runs of powers of two."""
    n = len(hashes) - size + 1
    out, done, part, span = None, 0, hashes, 1
    while True:
        if size & span:
            piece = part[done : done + n]
            out = piece if out is None else out * np.uint64(pow(base, span, 1 << 64)) + piece
            done += span
        if span * 2 > size:
            return out
        part = part[: len(part) - span] * np.uint64(pow(base, span, 1 << 64)) + part[span:]
        span *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the order of hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def windows(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and hash of every window."""
    hashes = word_hashes(words)
    grams = mixed(rolling(hashes, gram, BASES[0]))
    return sliding_least(grams, window - gram + 1), rolling(hashes, window, BASES[1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbouring values."""
    span, part = 1, values
    while span * 2 <= width:
        part = np.minimum(part[: len(part) - span], part[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(part[:n], part[width - span : width - span + n])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def find_anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
        found, rows = [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            words = text.encode().split()
            if len(words) >= window:
                anchors = np.unique(windows(words, window, gram)[0])
                found.append(anchors)
                rows.append(np.full(len(anchors), row))
        if found:
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(found)), pa.array(ids[at]), pa.array(marks[at])], ["anchor", "id", "mark"])


FACTOR = [("start", "int"), ("source", "bigint"), ("source_start", "int"), ("length", "int")]
FACTORS = f"array<struct<{','.join(f'{n}:{t}' for n, t in FACTOR)}>>"
RUN_SCHEMA = f"id long, mark long, anchor long, start int, words binary, factors {FACTORS}"
FACTOR_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("length", pa.int32())]))


class Block:
    """A reference block: rows of words that start at a word of a document, and their windows (anchor, hash, place in the row, row), by row and place."""

    def __init__(self, rows: list[list[bytes]], ids: np.ndarray, starts: np.ndarray, anchors: np.ndarray, hashes: np.ndarray, at: np.ndarray, row: np.ndarray, window: int):
        self.rows, self.ids, self.starts, self.window, self.at, self.row = rows, ids, starts, window, at, row
        order = np.lexsort((starts[row] + at, ids[row], hashes, anchors))
        new = np.ones(len(order), bool)
        new[1:] = (anchors[order][1:] != anchors[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        #: For each window the one of the smallest place that equals it.
        self.source = np.empty(len(order), np.int64)
        self.source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]

    def parse(self) -> list[tuple[int, int, int, int, int]]:
        """Factors (row, word, row and word of the reference, length), by row and word: each follows its reference as far as the texts agree."""
        row, at, source = self.row, self.at, self.source
        there, where = row[source], at[source]
        found = self.ids[row] > self.ids[there]
        # Windows that follow one another in both texts are one match, seen at its first window.
        goes_on = np.zeros(len(row), bool)
        goes_on[1:] = found[:-1] & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (there[1:] == there[:-1]) & (where[1:] == where[:-1] + 1)
        out, last_row, covered = [], -1, 0
        for j in np.flatnonzero(found & ~goes_on).tolist():
            r, p, q, x = int(row[j]), int(at[j]), int(there[j]), int(where[j])
            if r != last_row:
                last_row, covered = r, 0
            run = 1
            while j + run < len(row) and goes_on[j + run]:
                run += 1
            if p + run - 1 + self.window <= covered:
                continue
            # Windows of this match that the factor before has are left to it.
            skip = max(0, covered - self.window - p + 1)
            p, x, run = p + skip, x + skip, run - skip
            ours, theirs, n = self.rows[r], self.rows[q], run - 1 + self.window
            if ours[p : p + n] != theirs[x : x + n]:
                continue
            while p + n < len(ours) and x + n < len(theirs) and ours[p + n] == theirs[x + n]:
                n += 1
            covered = p + n
            out.append((r, p, q, x, n))
        return out


def packed_factors(block: Block, found: list[tuple[int, int, int, int, int]]) -> list[dict]:
    return [{"start": int(block.starts[r]) + p, "source": int(block.ids[q]), "source_start": int(block.starts[q]) + x, "length": n} for r, p, q, x, n in found]


def batch_of(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), FACTOR_TYPE]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["id", "mark", "anchor", "start", "words", "factors"])


def runs_of_batch(texts: list[list[bytes]], ids: list[int], marks: list[int], shared: list[np.ndarray], window: int, gram: int) -> pa.RecordBatch | None:
    """Documents of a batch parsed against each other: their factors, and runs of words whose windows found no reference here."""
    a, h, at, row = [], [], [], []
    for i, words in enumerate(texts):
        anchor, hashes = windows(words, window, gram)
        can = np.flatnonzero(np.isin(anchor, shared[i]))
        a.append(anchor[can]), h.append(hashes[can]), at.append(can), row.append(np.full(len(can), i))
    a, h, at, row = map(np.concatenate, (a, h, at, row))
    if not len(a):
        return None
    block = Block(texts, np.array(ids), np.zeros(len(ids), np.int64), a, h, at, row, window)
    found = block.parse()
    out, settled = [], np.zeros(len(row), bool)
    of_row: dict[int, list] = {}
    for f in found:
        of_row.setdefault(f[0], []).append(f)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for r, factors_of in of_row.items():
        part = slice(bounds[r], bounds[r + 1])
        for _, p, _, _, n in factors_of:
            settled[part] |= (at[part] >= p) & (at[part] + window <= p + n)
        out.append([ids[r], marks[r], None, None, None, packed_factors(block, factors_of)])
    left = np.flatnonzero(~settled)
    if len(left):
        new = np.append(True, (row[left][1:] != row[left][:-1]) | (a[left][1:] != a[left][:-1]) | (at[left][1:] != at[left][:-1] + 1))
        first = np.flatnonzero(new)
        for i, n in zip(first.tolist(), np.diff(np.append(first, len(left))).tolist()):
            r, p = int(row[left[i]]), int(at[left[i]])
            out.append([ids[r], marks[r], int(a[left[i]].view(np.int64)), p, b" ".join(texts[r][p : p + n - 1 + window]), None])
    return batch_of(out)


def find_runs(batches: Iterator[pa.RecordBatch], window: int, gram: int, block_words: int) -> Iterator[pa.RecordBatch]:
    texts, ids, marks, anchors, held = [], [], [], [], 0
    for batch in batches:
        for doc, mark, text, found in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist(), batch.column("anchors")):
            words = text.encode().split()
            texts.append(words), ids.append(doc), marks.append(mark), anchors.append(found.values.to_numpy().view(np.uint64))
            held += len(words)
            if held >= block_words:
                if (out := runs_of_batch(texts, ids, marks, anchors, window, gram)) is not None:
                    yield out
                texts, ids, marks, anchors, held = [], [], [], [], 0
    if texts and (out := runs_of_batch(texts, ids, marks, anchors, window, gram)) is not None:
        yield out


def windows_of_runs(batch: pa.RecordBatch, window: int, bases: tuple[int, ...] = (BASES[1],)) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each run, and row, place and hashes of each window of a run."""
    rows = [w.split(b" ") for w in batch.column("words").to_pylist()]
    sizes = np.array([len(r) for r in rows])
    hashes = word_hashes([w for r in rows for w in r])
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
    inside = np.flatnonzero(at + window <= sizes[row])
    return rows, row[inside], at[inside], [rolling(hashes, window, base)[inside] for base in bases]


def parse_runs(batches: Iterator[pa.RecordBatch], window: int, block_runs: int) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by anchor, parsed in blocks of whole anchors."""
    schema = ["id", "mark", "factors"]

    def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, row, at, (hashes,) = windows_of_runs(batch, window)
        column = lambda name: batch.column(name).to_numpy()
        block = Block(rows, column("id"), column("start").astype(np.int64), column("anchor")[row], hashes, at, row, window)
        found = block.parse()
        own = np.array([f[0] for f in found], np.int64)
        factors = pa.array([[f] for f in packed_factors(block, found)], FACTOR_TYPE)
        return pa.RecordBatch.from_arrays([pa.array(column("id")[own]), pa.array(column("mark")[own]), factors], schema)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        held = table.to_batches()[0] if table.num_rows else None
        while held is not None and held.num_rows > block_runs:
            anchors = held.column("anchor").to_numpy()
            change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if not len(change):
                break
            # As many whole anchors as a block takes, one at least; the last of a batch can go on in the next one.
            cut = int(change[max(0, np.searchsorted(change, block_runs, "right") - 1)])
            yield parsed(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield parsed(held)


def hot_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of runs: its anchor, two hashes and place."""
    for batch in batches:
        if batch.num_rows:
            _, row, at, (first, second) = windows_of_runs(batch, window, (BASES[1], BASES[0]))
            pick = lambda name: batch.column(name).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(pick("anchor")), signed(first), signed(second), pa.array(pick("id")), pa.array(pick("mark")), pa.array((pick("start") + at).astype(np.int32))], ["anchor", "first", "second", "id", "mark", "start"])


def joined_factors(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """Factors of one document (word, reference document and word, length) that cover the words of all found ones and don't overlap.

    Pieces of one reference and offset that touch are one; of those that start by a word, the one that reaches furthest follows.
    """
    pieces: list[list[int]] = []
    for f in sorted(found, key=lambda f: (f["source"], f["source_start"] - f["start"], f["start"])):
        start, end = f["start"], f["start"] + f["length"]
        if pieces and pieces[-1][2] == f["source"] and pieces[-1][3] == f["source_start"] - start and start <= pieces[-1][1]:
            pieces[-1][1] = max(pieces[-1][1], end)
        else:
            pieces.append([start, end, f["source"], f["source_start"] - start])
    pieces.sort(key=lambda p: (p[0], -p[1], p[2]))
    out, done, i = [], 0, 0
    while i < len(pieces):
        best = None
        while i < len(pieces) and (pieces[i][0] <= done or best is None and pieces[i][1] > done):
            if pieces[i][0] > done:
                done = pieces[i][0]
            if pieces[i][1] > done and (best is None or pieces[i][1] > best[1]):
                best = pieces[i]
            i += 1
        if best is not None:
            out.append((done, best[2], done + best[3], best[1] - done))
            done = best[1]
    return out


def cut_factors(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, spans, texts = [], [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist()):
            words = text.encode().split()
            kept, cut = words, joined_factors(found) if found else []
            if cut:
                stay = np.ones(len(words), bool)
                for start, _, _, length in cut:
                    stay[start : start + length] = False
                kept = list(compress(words, stay))
            joined = b" ".join(kept)
            n_words.append(len(words)), n_removed.append(len(words) - len(kept)), digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                spans.append([dict(zip(("start", "source", "source_start", "length"), f)) for f in cut]), texts.append(joined.decode())
        out = {"id": batch.column("given"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_pydict(out | {"factors": pa.array(spans, FACTOR_TYPE), "kept": pa.array(texts, pa.string())} if with_text else out)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8, block_words: int = 500_000, block_runs: int = 4000, hot_entries: int = 1000, with_text: bool = False,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256; with_text adds factors (start, source: the reference document, source_start, length; in words) and the kept words.

    Texts go through a shuffle twice, to meet their shared anchors and their factors; besides, the runs of words that can be shared do.
    """
    id_long = F.col(id_col).cast("long")
    rows = docs.select(id_long.alias("given"), F.coalesce(id_long, F.lit(LAST)).alias("id"), F.xxhash64(whole(text_col)).alias("mark"), whole(text_col).alias("text"))
    anchors = keep(rows.select("id", "mark", "text").mapInArrow(lambda b: find_anchors(b, window, gram), "anchor long, id long, mark long"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    some = rows.select("id", "mark", "text").join(wanted.hint("shuffle_hash"), ["id", "mark"])
    parsed = keep(some.mapInArrow(lambda b: find_runs(b, window, gram, block_words), RUN_SCHEMA), instead_of=anchors)
    runs = parsed.where("anchor is not null").select("anchor", "id", "mark", "start", "words")
    hot = keep(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_entries).select("anchor"))
    any_hot = not hot.isEmpty()
    cold = runs.join(hot, "anchor", "left_anti") if any_hot else runs
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: parse_runs(b, window, block_runs), f"id long, mark long, factors {FACTORS}")
    if any_hot:
        name = ["anchor", "first", "second"]
        spread = keep(runs.join(hot, "anchor").mapInArrow(lambda b: hot_windows(b, window), "anchor long, first long, second long, id long, mark long, start int"))
        least = spread.groupBy(*name).agg(F.min(F.struct("id", "start")).alias("least"))
        factor = F.struct("start", F.col("least.id").alias("source"), F.col("least.start").alias("source_start"), F.lit(window).alias("length"))
        found = found.union(spread.join(least, name).where("id > least.id").select("id", "mark", F.array(factor).cast(FACTORS).alias("factors")))
    found = found.union(parsed.where("anchor is null").select("id", "mark", "factors"))
    factors = keep(found.groupBy("id", "mark").agg(F.flatten(F.collect_list("factors")).alias("factors")), instead_of=parsed)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + f", factors {FACTORS}, kept string" * with_text
    out = rows.join(factors.hint("shuffle_hash"), ["id", "mark"], "left").select("given", "text", "factors").mapInArrow(lambda b: cut_factors(b, with_text), schema)
    return out.withColumnRenamed("id", id_col)
