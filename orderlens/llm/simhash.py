"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two that differ in at most three bits differ in at most three bytes, so they share
at least five of eight (position, byte) pairs: five is the guaranteed minimum of matches. Members of a posting list for each
(position, byte) are paired, shared bytes are tallied per pair over all lists, pairs below five are dropped and the rest verified bit by bit.

A posting list per single byte over all rows would hold a 256th of them, so the index is cut into blocks first: of any five positions, three
lie in one half (0-3 or 4-7), so a pair that reaches the minimum shares three positional bytes of one half and meets in one of the eight
blocks that are keyed by these (a prefix filter, which misses no pair). Within a block the index is the one above. Blocks longer than
``long_list`` (counted first) are cut by two more of the remaining positions, which a pair of five matches shares as well. There the minimum is
reached by all, and at most 2^24 fingerprints are possible; above ``all_pairs`` members they are searched by flipping up to three of the open
bits, in time proportional to their number. A block gives a spanning star per local component, never its pairs.

Rows of one fingerprint meet before the index, so copies cost nothing there.

For similarities that are many bits apart there is a wide form, similar_links(): positions of `width` bits rather than bytes, as many of them as bring any
near pair together at one at least (that minimum of matches fails for a pair in `MISS` cases), and a count of the agreeing bits of the first 192 for each pair of a list.

Defined results: a null or empty text has fingerprint zero and is linked like any other; null ids: see near_components(); ties of ids don't
matter, as the smallest names a component; texts of any length are read whole; repeated rows share a component; an empty table gives an empty result; other columns are ignored, and kept by drop_near_copies().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, marked, spread_join, stay, whole
from .graph import stars

BITS = 3
MATCHES = 8 - BITS
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, size: int = 3, block: int = 200_000) -> int:
    """Of word shingles with repeats, A-Z lower-cased: a bit is 1 if set in over half of the hashes. No words: 0."""
    words = text.encode().lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    ones = np.zeros((8, 8), np.int64)
    for start in range(0, n, block):
        part = words[start : start + block + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, min(block, n - start))
        columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[i] += np.bincount(columns[:, i], minlength=256) @ BIT_OF_BYTE
    return int.from_bytes(np.packbits(ones * 2 > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, check, fp): fp is the fingerprint as a signed 64-bit integer; mark and check name the text."""
    names = ["id", "mark", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "fp"])

    rows = marked(docs.select(id_col, text_col), id_col, text_col, *names)
    return rows.select(*names, whole(text_col).alias("text")).mapInArrow(run, "id long, mark long, check int, fp long")


def pairs_within(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (earlier, later) of all pairs of equal values in a sorted array."""
    start = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, np.int64)
    rank = np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))
    later = np.repeat(np.arange(len(groups)), rank)
    return later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(rank) - rank, rank)), later


def near_pairs(values: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one block that share MATCHES positional bytes, by postings and a tally, and differ in BITS bits at most. Values come by block."""
    n, starts = len(values), np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    number = np.cumsum(np.append(0, (block[1:] != block[:-1]).astype(np.int64)))
    common = np.zeros(len(starts), np.int64)
    seen = []
    for position in range(8):
        byte = ((values >> np.uint64(8 * position)) & np.uint64(255)).astype(np.int64)
        # A byte that a whole block has counts for each of its pairs without a posting.
        everywhere = np.minimum.reduceat(byte, starts) == np.maximum.reduceat(byte, starts)
        common += everywhere
        posted = np.flatnonzero(~everywhere[number])
        posted = posted[np.argsort(number[posted] * 256 + byte[posted], kind="stable")]
        earlier, later = pairs_within(number[posted] * 256 + byte[posted])
        seen.append(posted[earlier] * n + posted[later])
    pair, tally = np.unique(np.concatenate(seen), return_counts=True)
    enough = tally + common[number[pair // n]] >= MATCHES
    reached = np.flatnonzero((common >= MATCHES)[number])
    earlier, later = pairs_within(number[reached])
    a, b = np.concatenate([pair[enough] // n, reached[earlier]]), np.concatenate([pair[enough] % n, reached[later]])
    near = np.bitwise_count(values[a] ^ values[b]) <= BITS
    return a[near], b[near]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that links reach from it."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return label


def by_flipping(members: np.ndarray) -> np.ndarray:
    """For each of the sorted distinct fingerprints the place of its component's first member."""
    n, fixed = len(members), members[0] ^ members
    open_bits = [i for i in range(64) if int(np.bitwise_or.reduce(fixed)) >> i & 1]
    us, vs = [], []
    for k in range(1, BITS + 1):
        for bits in combinations(open_bits, k):
            other = members ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(members, other), n - 1)
            hit = np.flatnonzero((members[at] == other) & (at > np.arange(n)))
            us.append(hit), vs.append(at[hit])
    return components(n, np.concatenate(us), np.concatenate(vs))


def link_lists(batches: Iterator[pa.RecordBatch], all_pairs: int, at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    def stars_of(members: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        off = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (members[off], members[label[off]])], ["u", "v"])

    for batch in batches:
        lists = batch.column("fps")
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        for i in np.flatnonzero(sizes > all_pairs):
            members = np.sort(values[offsets[i] : offsets[i + 1]])
            yield stars_of(members, by_flipping(members))
        # As many blocks at once as have so many pairs together.
        short = np.flatnonzero(sizes <= all_pairs)
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(sizes[short] ** 2) // at_once)) + 1):
            if len(part):
                block = np.repeat(part, sizes[part])
                members = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in part])
                order = np.lexsort((members, block))
                yield stars_of(members[order], components(len(order), *near_pairs(members[order], block)))


def byte_at(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def packed(positions: tuple[int, ...], tag: int):
    """The bytes at the positions and a tag, as one integer."""
    key = F.lit(tag).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(byte_at(p))
    return key


def links(distinct: DataFrame, long_list: int = 1024, all_pairs: int = 1024) -> DataFrame:
    """(u, v): enough links between near fingerprints (column fp, distinct) for their components; each within three bits or of one local component."""
    triples = F.explode(F.array(*[packed(t, i + 1) for i, t in enumerate(TRIPLES)])).alias("list")
    postings = distinct.select("fp", triples)
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hot = keep(sizes.where(F.col("size") > long_list).select("list"))
    some = not hot.isEmpty()
    rest = (postings.join(hot, "list", "left_anti") if some else postings).groupBy("list").agg(F.collect_list("fp").alias("fps"))
    lists = rest.where("size(fps) > 1").select("fps")
    if some:
        finer = None
        for i, triple in enumerate(TRIPLES):
            others = [p for p in range(8) if p not in triple]
            keys = F.array(*[packed((*triple, *two), k) for k, two in enumerate(combinations(others, MATCHES - len(triple)))])
            finer = F.when(F.shiftrightunsigned("list", 24) == i + 1, keys) if finer is None else finer.when(F.shiftrightunsigned("list", 24) == i + 1, keys)
        cut = postings.join(hot, "list").select("fp", "list", F.explode(finer).alias("bytes"))
        lists = lists.union(cut.groupBy("list", "bytes").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps"))
    return lists.mapInArrow(lambda batches: link_lists(batches, all_pairs), "u long, v long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = 1024, with_marks: bool = False) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable over links, its own included); with_marks: id, mark, check and root instead.

    A null or empty text has fingerprint zero and is linked like any other; a null id gets its component's smallest id, or null
    if there is none; repeated rows repeat their result; an empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col)
    rows = keep(rows if with_marks else rows.select("id", "fp"))
    groups = keep(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    star = stars(links(groups.select("fp"), long_list))
    member = groups.join(star.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(roots, "root").select("fp", "root", "component_id")
    out = spread_join(rows, named, "fp", groups.select("fp", "n"))
    if with_marks:
        return out.select("id", "mark", "check", "root")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row of the smallest id, a null id last; of rows of that id the text that hashes lowest."""
    rows = near_components(docs, id_col, text_col, with_marks=True, **how)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "check")
    rows = rows.select("root", "id", "mark", "check", rank.alias("rank"))
    rows = keep(rows)
    best = keep(rows.groupBy("root").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    told = spread_join(rows, best.select("root", "best"), "root", best.select("root", "n")).withColumn("kept", F.col("rank") == F.col("best"))
    return stay(docs, told.select("id", "mark", "check", "kept"), id_col, text_col)


MISS = 1e-5
#: Bits of a wide fingerprint that are counted for each pair, and how many of its words these are.
COUNTED, WORDS = 192, 3


def differing(similarity: float) -> float:
    """The share of a wide fingerprint's bits in which sets of a Jaccard similarity differ: the angle's, and a quarter more, as the majority of few hashes is coarser (0.1875 for four of five, 0.151 for many)."""
    return 1.25 * acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def positions(similarity: float, width: int) -> int:
    """How many positions of width bits bring pairs of the similarity together at one at least, but for MISS of them."""
    return max(-(-COUNTED // width), ceil(log(MISS) / log(1 - (1 - differing(similarity)) ** width)))


def most_differing(bits: int, similarity: float, deviations: float = 4) -> int:
    """How many of some bits differ at most between sets of the similarity, but for a few deviations' rest."""
    p = differing(similarity)
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def width_for(n: int, per_list: int = 2048) -> int:
    """Bits of a position for n fingerprints, so that a list has so many of them on average at most."""
    return max(8, ceil(log2(max(n, 1) / per_list)))


def wide_fingerprint(hashes: np.ndarray, bits: int, block: int = 255) -> np.ndarray:
    """The bits (0 or 1) of a set of 64-bit hashes: each hash is drawn out to as many, and a bit is 1 if set in over half of the set."""
    words = -(-bits // 64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for start in range(0, len(hashes), block):
        x = hashes[start : start + block, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (ones[:bits] * 2 > len(hashes)).astype(np.uint8)


def postings_of(width: int):
    """For rows (node, fp: the packed bits): list (position and its bits), node, and the words whose bits are counted, a row for each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                packed_bits = np.array([np.frombuffer(b, np.uint8) for b in part.column("fp").to_pylist()])
                lists = packed_bits.shape[1] * 8 // width
                bits = np.unpackbits(packed_bits, axis=1, bitorder="little", count=lists * width).reshape(-1, lists, width)
                key = (np.arange(lists) << width) + bits @ (1 << np.arange(width, dtype=np.int64))
                counted = np.ascontiguousarray(packed_bits[:, : COUNTED // 8]).view("<i8")
                nodes = part.column("node").to_numpy()
                columns = [key.ravel(), np.repeat(nodes, lists), *(np.repeat(counted[:, i], lists) for i in range(WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "node", *(f"w{i}" for i in range(WORDS))])

    return run


def counted_components(words: np.ndarray, similarity: float, cells: int = 1 << 15) -> np.ndarray:
    """For each member of a list (its words in a row) the first one that links reach: pairs of which enough bits agree, by a count for every pair (two words before the third)."""
    n = words.shape[1]
    label, rows = np.arange(n), max(1, cells // max(n, 1))
    first, most = most_differing(128, similarity, 5), most_differing(COUNTED, similarity)
    for i in range(0, n, rows):
        here = words[:, i : i + rows, None]
        differ = np.bitwise_count(here[0] ^ words[0, i:])
        differ += np.bitwise_count(here[1] ^ words[1, i:])
        a, b = np.divmod(np.flatnonzero(differ <= first), n - i)
        a, b = a[a < b], b[a < b]
        near = differ[a, b] + np.bitwise_count(words[2, a + i] ^ words[2, b + i]) <= most
        a, b = a[near] + i, b[near] + i
        if len(a):
            held = np.flatnonzero(label != np.arange(n))
            label = components(n, np.append(held, a), np.append(label[held], b))
    return label


def counted_lists(similarity: float):
    """For rows sorted by list: stars (node, leader) of each list's components."""

    def stars_of(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.argsort(rows[1], kind="stable")]
        label = counted_components(rows[2:].view(np.uint64), similarity)
        off = np.flatnonzero(label != np.arange(len(label)))
        return rows[1][off], rows[1][label[off]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.array([batch.column(c).to_numpy() for c in ("list", "node", *(f"w{i}" for i in range(WORDS)))])
            found = []
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if held and part.shape[1] and held[0][0, 0] != part[0, 0]:
                    found.append(stars_of(held))
                    held = []
                held.append(part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["node", "leader"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars_of(held)], ["node", "leader"])

    return run


def similar_links(nodes: DataFrame, similarity: float, width: int, long_list: int = 1 << 14) -> DataFrame:
    """(node, leader), distinct, leader the smaller: stars that link all nodes (columns node and fp, distinct) whose wide fingerprints share a position and enough of the counted bits.

    A list of over long_list members, which only near copies make, is one star without a count: what is proposed in vain costs a comparison, what isn't is lost.
    """
    columns = ", ".join(f"w{i} long" for i in range(WORDS))
    postings = nodes.select("node", "fp").mapInArrow(postings_of(width), f"list long, node long, {columns}")
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    hot = keep(sizes.where(F.col("n") > long_list))
    some = not hot.isEmpty()
    rest = postings.join(hot, "list", "left_anti") if some else postings
    found = rest.repartition("list").sortWithinPartitions("list").mapInArrow(counted_lists(similarity), "node long, leader long")
    if some:
        found = found.union(spread_join(postings.select("list", "node"), hot.select("list", "leader"), "list", hot.select("list", "n")).where("node <> leader").select("node", "leader"))
    return keep(found.distinct())
