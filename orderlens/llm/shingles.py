"""Near copies by word shingles: sets of five-word shingles whose Jaccard similarity is 0.8 or more, proposed by SimHash and verified exactly.

A set has a wide SimHash. The index of its positions (simhash.similar_links) only proposes: positions of eight bits or more, so many that a pair of similarity 0.8
shares one with probability 0.99999 at least, and more similar pairs more surely; of the pairs that share one, those with enough agreeing bits of 192 are
candidates, and candidates that are linked over lists make a part. Within a part the sets are compared exactly: first each with four leaders (smallest set) of its lists at most, which settles most of a large family of
near copies in time proportional to its size. Sets that are left outside their part's largest group are compared with all sets of the part,
through an index of shingles, in blocks of bounded size; so no link within a part is lost, and no task holds a part.

Rows of one shingle set meet before the search; a text of fewer words than a shingle has itself as its only shingle.

Defined results: a null text is the empty one, and all texts without words are one group; a null id comes after all others; rows that repeat an id are told apart by their texts, of
rows that repeat both one stays; ties of a group's leader go to the smallest id; texts of any length are read whole; an empty table stays empty; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, marked, spread_join, stay, whole
from .graph import stars
from .simhash import positions, similar_links, wide_fingerprint, width_for

#: Positions of a SimHash and the bits of each, for tables of up to a million sets and a similarity of 0.8.
BANDS, MINIMA = positions(0.8, 8), 8


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, minima: int) -> DataFrame:
    """(id, mark, check, node, fp): mark and check are of the text, node of its shingle set, fp the set's SimHash of that many positions and bits of each."""
    names = ["id", "mark", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, size)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                found.append(np.packbits(wide_fingerprint(hashes, bands * minima), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], [*names, "node", "fp"])

    rows = marked(docs.select(id_col, text_col), id_col, text_col, *names).select(*names, whole(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, mark long, check int, node long, fp binary")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def near_in_block(asking: list[np.ndarray], block: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking, block) of the pairs of sets at or above the similarity, by an index of the block's shingles."""
    sizes = np.array([len(s) for s in block], np.int64)
    owner = np.repeat(np.arange(len(block)), sizes)
    token = np.concatenate([*block, np.empty(0, np.uint64)])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    us, vs = [], []
    for i, x in enumerate(asking):
        first, last = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
        hits = np.flatnonzero(last > first)
        shared = np.bincount(np.concatenate([owner[first[h] : last[h]] for h in hits]), minlength=len(block)) if len(hits) else np.zeros(len(block), np.int64)
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (len(x) + sizes - shared) - 1e-9))
        us.append(np.full(len(near), i)), vs.append(near)
    return np.concatenate([*us, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*vs, np.empty(0, np.int64)]).astype(np.int64)


def grouped(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nodes (column node) with the smallest node that links (u, v) reach."""
    star = stars(links)
    return nodes.select("node").join(star.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias(name))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (node, leader) those at or above the similarity, as links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("ours").to_pylist(), batch.column("theirs").to_pylist())
            keep_ = pa.array([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(keep_), batch.column("leader").filter(keep_)], ["u", "v"])

    theirs = sets.select(F.col("node").alias("leader"), F.col("hashes").alias("theirs"))
    with_ours = pairs.join(sets.select("node", F.col("hashes").alias("ours")), "node")
    return keep(spread_join(with_ours, theirs, "leader", pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), size="theirs").select("node", "leader", "ours", "theirs").mapInArrow(compare, "u long, v long"))


def links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, size: int, similarity: float, block: int = 2000, minima: int = MINIMA) -> DataFrame:
    """(node, root) of the nodes that are candidates."""
    pairs = similar_links(rows.select("node", "fp").dropDuplicates(["node"]), similarity, minima)
    used = pairs.select("node").union(pairs.select(F.col("leader").alias("node"))).distinct()
    # One row of each set brings its text.
    picked = rows.join(used, "node").groupBy("node").agg(F.min(F.struct("mark", "check", "id")).alias("r")).select(F.col("node").alias("_node"), "r.*")
    texts = marked(docs.select(id_col, text_col), id_col, text_col, "_id", "_mark", "_check").withColumn("_text", whole(text_col))
    texts = texts.join(picked.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark")) & (F.col("_check") == F.col("check"))).select(F.col("_node").alias("node"), F.col("_text").alias("text")).dropDuplicates(["node"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t, size).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["node", "hashes"])

    sets = keep(texts.mapInArrow(tokens, "node long, hashes binary"))
    nodes = sets.select("node")
    # A row for each node, with its leaders (as many as the index has positions at most): no join meets the pairs themselves.
    led = keep(pairs.groupBy("node").agg(F.min("leader").alias("least"), F.collect_set("leader").alias("leaders")))

    def sizes_of(group: DataFrame) -> DataFrame:
        return group.groupBy("group").agg(F.count(F.lit(1)).alias("n"))

    # A few leaders of each set settle most of a family; what they leave open is settled within the parts.
    drawn = F.slice(F.sort_array(F.transform("leaders", lambda x: F.struct(F.xxhash64("node", x).alias("draw"), x.alias("leader")))), 1, 2)
    tried = led.select("node", F.explode(F.array_distinct(F.concat(F.array("least", F.array_max("leaders")), F.transform(drawn, lambda x: x["leader"])))).alias("leader"))
    group = keep(grouped(nodes, verified(keep(tried), sets, similarity), "group"))
    # Candidates link sets to parts; within these no pair of groups is left out. A set's leaders are linked by the least of them, which many sets share.
    chain = led.select(F.col("node").alias("u"), F.col("least").alias("v")).union(led.select(F.explode("leaders").alias("u"), F.col("least").alias("v")).where("u <> v").distinct())
    state = keep(group.join(grouped(nodes, chain, "part"), "node"))
    split = state.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("part")
    split = keep(split.agg(F.sum("n").alias("n"), F.max_by("group", F.struct("n", "group")).alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups"))
    if split.isEmpty():
        return group.withColumnRenamed("group", "root")
    # Groups of n sets in blocks; those outside the largest group, in chunks, meet each block of their part.
    blocks = F.ceil(F.col("n") / block).cast("int")
    at = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")
    cut = spread_join(state, split.select("part", "largest", blocks.alias("blocks")), "part", split.select("part", "n")).withColumn("asks", F.col("group") != F.col("largest"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Chunks of a part that have sets which ask: a number for each block at most.
    busy = cut.where("asks").groupBy("part").agg(F.collect_set(at(2)).alias("chunks"))
    members = spread_join(cut, busy, "part", split.select("part", "n"))
    placed = members.select("part", "node", "group", F.lit(False).alias("asking"), at(1).alias("block"), F.explode("chunks").alias("chunk")).union(cut.where("asks").select("part", "node", "group", F.lit(True).alias("asking"), F.explode(everywhere).alias("block"), at(2).alias("chunk")))
    placed = placed.join(sets, "node").select("part", "block", "chunk", "asking", "group", "hashes")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asking, others = rows[rows["asking"]], rows[~rows["asking"]]
        as_sets = lambda df: [np.frombuffer(h, np.uint64) for h in df["hashes"]]
        a, b = near_in_block(as_sets(asking), as_sets(others), similarity)
        found = pd.DataFrame({"u": asking["group"].to_numpy()[a], "v": others["group"].to_numpy()[b]})
        return found[found["u"] != found["v"]].drop_duplicates()

    between = keep(placed.groupBy("part", "block", "chunk").applyInPandas(search, "u long, v long"))
    names = grouped(group.select(F.col("group").alias("node")).distinct(), between, "root").withColumnRenamed("node", "group")
    return keep(spread_join(group, names, "group", sizes_of(group)).select("node", "root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, minima: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group linked by near pairs the one of the smallest id, a null id last; of rows of that id the text that hashes lowest. minima: bits of a SimHash's position, if not by the number of rows."""
    minima = minima or width_for(docs.count())
    rows = keep(sketches(docs, id_col, text_col, size, positions(similarity, minima), minima))
    named = rows.select("node", "id", "mark", "check").join(links(docs, rows, id_col, text_col, size, similarity, minima=minima), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "check")
    named = keep(named)
    best = keep(named.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    told = spread_join(named, best.select("root", "best"), "root", best.select("root", "n")).withColumn("kept", rank == F.col("best"))
    return stay(docs, told.select("id", "mark", "check", "kept"), id_col, text_col)
