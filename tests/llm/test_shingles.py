"""Near copies by five-word shingles against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from orderlens.llm import graph, shingles, simhash
from orderlens.llm.common import keep, spread_join

from .helpers import corpus, docs


def brute(texts, similarity=0.8, size=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_stage_against_all_pairs(spark):
    texts = corpus(n=300, most=400)
    want = [i for i, c in enumerate(brute(texts)) if c == i]
    table = docs(spark, texts)
    kept = corpus_pipeline.stage_near_dedup(spark, table, "")
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == want and len(want) < 290
    assert shingles.drop_near_copies(docs(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    table = spark.createDataFrame([(1, a), (2, a + " x"), (2, b), (None, a + " y"), (None, "c d")], "doc_id long, text string")
    assert sorted(r["text"] for r in shingles.drop_near_copies(table).collect()) == sorted([a, b, "c d"])


@pytest.mark.parametrize("block", [2000, 7])
def test_families_in_small_blocks(spark, block):
    """Families of near copies of near copies, chains of them and lone texts, over many blocks, against all pairs."""
    rng = random.Random(8)
    texts = []
    for f in range(4):
        words = [f"f{f}w{i}" for i in range(90)]
        for k in range(40):
            if f % 2:
                words = [*words]
                words[rng.randrange(90)] = f"x{f}{k}"
                texts.append(" ".join(words))
            else:
                copy = [*words]
                for _ in range(rng.randrange(0, 4)):
                    copy[rng.randrange(90)] = f"y{f}{k}"
                texts.append(" ".join(copy))
    texts += ["lone text", None, ""]
    table = docs(spark, texts)
    rows = keep(shingles.sketches(table, "doc_id", "text", 5, shingles.BANDS, shingles.MINIMA))
    root = {r["node"]: r["root"] for r in shingles.links(table, rows, "doc_id", "text", 5, 0.8, block).collect()}
    node = {r["id"]: r["node"] for r in rows.collect()}
    ours, theirs = {}, {}
    for i, c in enumerate(brute(texts)):
        ours.setdefault(root.get(node[i], node[i]), set()).add(i)
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values())) and 6 < len(theirs) < 120


def test_pairs_of_a_block():
    rng = random.Random(3)
    source = list(range(60))
    sets = [np.unique(np.array(rng.sample(source, 55) + [100 + 7 * i + k for k in range(rng.randrange(1, 9))], np.uint64)) for i in range(50)]
    a, b = shingles.near_in_block(sets[:20], sets, 0.8)
    want = {(i, j) for i in range(20) for j in range(50) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-9}
    assert set(zip(a.tolist(), b.tolist())) == want and {(i, j) for i in range(20) for j in range(50) if shingles.similar(sets[i], sets[j], 0.8)} == want
    assert [len(x) for x in shingles.near_in_block([], sets, 0.8)] == [0, 0] and [len(x) for x in shingles.near_in_block(sets, [], 0.8)] == [0, 0]


def test_hot_keys_are_joined_alike(spark):
    """A key with most of the rows, with and without a table that is small enough to go to all tasks."""
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, id % 50, 7) AS k")
    table, counts = spark.range(50).selectExpr("id AS k", "repeat('x', 10) AS v"), rows.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for how in ({}, {"least": 5}, {"least": 5, "share": 10, "size": "v"}, {"least": 5, "most_bytes": 1}):
        assert sorted(map(tuple, spread_join(rows, table, "k", counts, **how).collect())) == want


@pytest.mark.parametrize("width, long_list", [(8, 1 << 14), (11, 1 << 14), (8, 5)])
def test_simhash_proposes_every_near_pair(spark, width, long_list):
    """The index of a wide SimHash links all pairs of similarity 0.8, of large sets and small, and few strangers unless a list is long."""
    rng = np.random.default_rng(width)
    sets, pairs = [], []
    for i in range(300):
        common, ours, theirs = ((4, 0, 1), (12, 1, 2), (40, 5, 5), (400, 0, 100))[i % 4]
        drawn = rng.integers(0, 1 << 64, common + ours + theirs, np.uint64)
        sets += [drawn[: common + ours], np.append(drawn[:common], drawn[common + ours :])]
        pairs.append((2 * i, 2 * i + 1))
    bits = simhash.positions(0.8, width) * width
    fps = [(i, bytearray(np.packbits(simhash.wide_fingerprint(s, bits), bitorder="little").tobytes())) for i, s in enumerate(sets)]
    found = {(r["leader"], r["node"]) for r in simhash.similar_links(spark.createDataFrame(fps, "node long, fp binary"), 0.8, width, long_list).collect()}
    label = simhash.components(len(sets), *(np.array([p[k] for p in found]) for k in (0, 1)))
    assert all(label[a] == label[b] for a, b in pairs)
    if long_list > 1000:
        assert set(pairs) <= found and len(found) < len(pairs) + 10  # strangers of four shingles are alike at times
    assert simhash.similar_links(spark.createDataFrame([], "node long, fp binary"), 0.8, width).count() == 0


def test_a_list_is_counted_by_pairs():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 64, (3, 90), np.uint64)
    words[:, 60:] = words[:, 30:60] ^ (np.uint64(1) << rng.integers(0, 64, (3, 30), np.uint64))  # three bits off
    label = simhash.counted_components(words, 0.8, cells=500)
    assert label.tolist() == [*range(60), *range(30, 60)]


def rows_of_joins(spark, run):
    """What run gives, and the rows that each join of its Spark executions made, by the join's text."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result, made = run(), Counter()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for at in range(before, store.executionsCount()):
        number = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            if "Join" in nodes.apply(i).name():
                metrics = nodes.apply(i).metrics()
                for m in (metrics.apply(k) for k in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made[re.sub(r"#\d+L?", "", nodes.apply(i).desc())] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return result, made


def test_joins_of_dense_links_make_no_more_rows_than_links(spark):
    """A long group whose nodes have many links each, and small groups: the stars of plain search, and no join makes more rows over all rounds than there are links."""
    rng, n, each = np.random.default_rng(9), 600, 30
    at = np.repeat(np.arange(n), each)
    dense = np.stack([at, np.maximum(at - 1 - rng.integers(0, 60, len(at)), 0)])
    thin = np.stack([n + np.arange(300), n + np.arange(300) // 6 * 6])
    links = np.unique(rng.permutation(n + 300)[np.concatenate([dense, thin], axis=1)].T, axis=0)
    table = keep(spark.createDataFrame(links.tolist(), "u long, v long"))
    star, made = rows_of_joins(spark, lambda: sorted(map(tuple, graph.stars(table).collect())))
    label = simhash.components(n + 300, *links.T)
    assert star == [(i, int(k)) for i, k in enumerate(label) if i != k] and len(star) == n - 1 + 250
    assert max(made.values()) <= 1.25 * len(links), made.most_common(3)


def test_strangers_with_a_common_line_take_joins_of_a_few_rows_a_text(spark):
    """Texts that are half alike are proposed over many lists: the stage's joins take a few rows for each text, not one for each proposal, and its groups are those of all pairs."""
    rng, n = random.Random(4), 700
    common = " ".join(f"c{i}" for i in range(24))
    texts = [f"{common} " + " ".join(f"t{i}w{k}" for k in range(rng.randrange(3, 8))) for i in range(n)]
    texts += [texts[i] + " x" for i in range(0, n, 7)]
    kept, made = rows_of_joins(spark, lambda: sorted(r["doc_id"] for r in shingles.drop_near_copies(docs(spark, texts)).collect()))
    assert kept == [i for i, c in enumerate(brute(texts)) if c == i] and len(kept) > 300
    assert max(made.values()) <= 8 * len(texts), made.most_common(5)
