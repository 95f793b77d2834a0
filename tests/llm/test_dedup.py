import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from orderlens.llm import exact_dedup, simhash, substring

from .helpers import corpus, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup_against_brute_force(spark, largest):
    texts = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), keep_largest=largest, fan_in=2).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(texts)
    for text, members in groups.items():
        keep = max(members) if largest else min(members)
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(members), i == keep)
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark):
    """Repeated ids with equal and other texts, null ids, and columns of names used inside."""
    rows = [(1, "alpha beta"), (1, "other text here"), (2, "alpha beta"), (3, "zz"), (3, "zz"), (4, "Case"), (4, "cASE"), (None, "zz"), (None, "lone"), (None, "lone"), (5, None), (6, "")]
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, id int, mark int, kept int, key_id int")


def test_exact_dedup_odd_rows(spark):
    table = odd_rows(spark)
    rows = exact_dedup.exact_dedup(table).collect()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows)
    assert got == sorted(
        [("1", "1", 2, True), ("1", "1", 1, True), ("2", "1", 2, False), ("3", "3", 3, True), ("3", "3", 3, True), ("4", "4", 2, True), ("4", "4", 2, True)]
        + [("None", "3", 3, False), ("None", "None", 2, True), ("None", "None", 2, True), ("5", "5", 2, True), ("6", "5", 2, False)]
    )
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_drop_copies_odd_rows(spark, largest):
    table = odd_rows(spark)
    kept = exact_dedup.drop_copies(table, keep_largest=largest)
    rows = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    want = [(2 if largest else 1, "alpha beta"), (1, "other text here"), (None if largest else 3, "zz"), (4, "case"), (None, "lone"), (6 if largest else 5, "")]
    assert kept.columns == table.columns and sorted(rows, key=str) == sorted(want, key=str)
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0
    many = docs(spark, corpus())
    assert exact_dedup.drop_copies(many).columns == many.columns


def test_drop_near_copies_odd_rows(spark):
    table = odd_rows(spark)
    kept = simhash.drop_near_copies(table)
    rows = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    want = [(1, "alpha beta"), (1, "other text here"), (3, "zz"), (4, "case"), (None, "lone"), (5, "")]
    assert kept.columns == table.columns and sorted(rows, key=str) == sorted(want, key=str)
    found = simhash.near_components(table).collect()
    assert len(found) == 12 and {r["component_id"] for r in found if r["doc_id"] is None} == {3, None}


def brute_fingerprint(text):
    words = [w.lower() for w in words_of(text)]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("long_list", [1024, 2])
def test_simhash_against_brute_force(spark, long_list):
    texts = corpus(n=200, most=400)
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_components(docs(spark, texts), long_list=long_list).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len({(t or "").translate(LOWER) for t in texts})
    assert simhash.near_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("long_list", [1024, 3])
def test_simhash_links_of_chains(spark, long_list):
    rng = random.Random(2)
    fps = []
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    star = {r["u"] & (2**64 - 1): r["v"] & (2**64 - 1) for r in simhash.stars(simhash.links(table, long_list)).collect()}
    want = brute_components(fps)
    groups = defaultdict(set)
    for f in fps:
        groups[star.get(f, f)].add(f)
    brute = defaultdict(set)
    for f, c in zip(fps, want):
        brute[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_simhash_long_lists_by_flipping():
    rng = np.random.default_rng(1)
    members = np.unique(np.uint64(0xABCDEF0123 << 24) + rng.integers(0, 1 << 24, 300).astype(np.uint64))
    members = np.unique(np.concatenate([members, members ^ np.uint64(7), members ^ np.uint64(1 << 20)]))
    tallied = simhash.components(len(members), *simhash.near_pairs(members, np.zeros(len(members), np.int64)))
    assert (simhash.by_flipping(members) == tallied).all() and len(set(tallied)) < len(members)


def test_simhash_tally_against_all_pairs():
    """Pairs of several blocks at once: those within three bits that are in one block, none else."""
    rng = random.Random(9)
    values, block = [], []
    for k in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 60)):
            values.append(base ^ sum(1 << b for b in rng.sample(range(rng.choice([8, 64])), rng.randrange(0, 5))))
            block.append(k)
    a, b = simhash.near_pairs(np.array(values, np.uint64), np.array(block))
    want = {(i, j) for j in range(len(values)) for i in range(j) if block[i] == block[j] and (values[i] ^ values[j]).bit_count() <= 3}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want and len(want) > 500


def test_simhash_blocks():
    text = " ".join(f"t{i % 977}" for i in range(5000))
    assert simhash.fingerprint(text, block=700) == simhash.fingerprint(text) == brute_fingerprint(text)


def brute_substring(texts, ids, window):
    first = {}
    rows = [words_of(t) for t in texts]
    for i, w in zip(ids, rows):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in zip(ids, rows):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        stay = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(stay).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram", "block", "hot"), [(50, 8, 1_000_000, 1000), (50, 8, 500, 1000), (10, 4, 300, 3)])
def test_substring_against_brute_force(spark, window, gram, block, hot):
    texts = corpus(n=150, words=40)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(docs(spark, texts), window=window, gram=gram, block_words=block, hot_entries=hot).collect()}
    want = brute_substring(texts, range(len(texts)), window)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 500


@pytest.mark.parametrize("hot", [1000, 3])
def test_factors_name_their_reference(spark, hot):
    texts = corpus(n=150, words=40)
    rows = {r["doc_id"]: r for r in substring.substring_dedup(docs(spark, texts), window=20, gram=5, block_words=2000, block_runs=7, hot_entries=hot, with_text=True).collect()}
    words, total = [words_of(t) for t in texts], 0
    for i, r in rows.items():
        end = 0
        for f in r["factors"]:
            ours, theirs = words[i], words[f["source"]]
            assert f["source"] < i and f["start"] >= end and f["length"] > 0
            assert ours[f["start"] : f["start"] + f["length"]] == theirs[f["source_start"] : f["source_start"] + f["length"]]
            end = f["start"] + f["length"]
        assert sum(f["length"] for f in r["factors"]) == r["n_removed"]
        total += len(r["factors"])
    assert total > 20


def test_a_long_copy_is_one_factor(spark):
    """Copied over many anchors and blocks, a passage stays one factor; an edit cuts it."""
    passage = [f"p{i * i % 977}" for i in range(900)]
    edited = [*passage[:400], "edit", *passage[401:]]
    texts = [" ".join(["a"] * 30 + passage), "b " * 10, " ".join(passage), " ".join(["c"] * 70 + edited)]
    rows = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring.substring_dedup(docs(spark, texts).repartition(4), block_words=100, with_text=True).collect()}
    assert rows[2] == [(0, 0, 30, 900)] and rows[0] == rows[1] == []
    assert rows[3] == [(70, 0, 30, 400), (471, 0, 431, 499)]


def test_substring_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    table = docs(spark, [passage, passage]).union(docs(spark, [passage, passage + " end"]))
    rows = substring.substring_dedup(table, with_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], [tuple(f) for f in r["factors"]], r["kept"] != passage) for r in rows) == [(0, 0, [], False)] * 2 + [(1, 60, [(0, 0, 0, 60)], True)] * 2
    assert substring.substring_dedup(docs(spark, [])).count() == 0
