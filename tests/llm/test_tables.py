import hashlib
import math
import random
import statistics
import unicodedata
from collections import Counter
from itertools import product

import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import merkle, mixing, urls

from .helpers import corpus, docs


def brute_leaves(paragraph):
    """Character by character: after a space behind a sign, an e or an s, at the end, or after 40 characters."""
    out, start = [], 0
    while start < len(paragraph):
        end = next((e for e in range(start + 1, start + 41) if e >= len(paragraph) or paragraph[e] == " " and (unicodedata.category(paragraph[e - 1])[0] not in "LN" or paragraph[e - 1] in "es")), None)
        end = start + 40 if end is None else min(end + 1, len(paragraph))
        out.append(paragraph[start:end])
        start = end
    return out or [""]


def brute_tree(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [[sha(s) for s in brute_leaves(p)] for p in text.split("\n")]
    paragraphs = [sha("".join(p)) for p in leaves]
    sections, start = [], 0
    for i, p in enumerate(paragraphs):
        if p[0] in "01" or i == len(paragraphs) - 1:
            sections.append((start, i + 1))
            start = i + 1
    root = sha("".join(sha("".join(paragraphs[a:b])) for a, b in sections))
    return root + ":" + ";".join("/".join("".join(h[:6] for h in p) for p in leaves[a:b]) for a, b in sections)


def brute_likeness(ours, theirs):
    """Equal sections share their leaves; those of the others are compared as sets."""
    cut = lambda f: f.partition(":")[2].split(";")
    leaves = lambda branches: {m for b in branches for p in b.split("/") for m in (p[i : i + 6] for i in range(0, len(p), 6))}
    a, b = set(cut(ours)), set(cut(theirs))
    same, left, right = len(leaves(a & b)), leaves(a - b), leaves(b - a)
    return 2 * (same + len(left & right)) / (2 * same + len(left) + len(right))


def brute_change(ours, theirs):
    """The first leaf, from the start, at which the nested lists differ."""
    if ours.partition(":")[0] == theirs.partition(":")[0]:
        return None
    a, b = ([[[p[i : i + 6] for i in range(0, len(p), 6)] for p in s.split("/")] for s in f.partition(":")[2].split(";")] for f in (ours, theirs))
    place = []
    for _ in range(3):
        start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        end = next((i for i, (x, y) in enumerate(zip(a[start:][::-1], b[start:][::-1])) if x != y), min(len(a), len(b)) - start)
        place.append(start)
        a, b = ([x for part in t[start : len(t) - end] for x in part] for t in (a, b))
    return ".".join(map(str, place))


def test_merkle_against_brute_force(spark):
    texts = [t or "" for t in corpus()]
    ids = [7 * i % 1000 - 300 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t or None, 9) for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint int").repartition(5)
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(table).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(texts)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == brute_tree(text) and row["edited_fingerprint"] == brute_tree(edited)
        for name, other in (("near_edited", edited), ("near_next", following)):
            assert row[name] == pytest.approx(brute_likeness(brute_tree(text), brute_tree(other)))
        assert row["first_change"] == brute_change(brute_tree(text), brute_tree(edited))


def test_merkle_odd_rows(spark):
    one = merkle.compare_with_edit(docs(spark, ["ab. cd. ef."])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert merkle.compare_with_edit(docs(spark, [])).count() == 0
    repeated = docs(spark, ["a b", "c d"]).union(docs(spark, ["a b"]))
    assert merkle.compare_with_edit(repeated).count() == 3


@pytest.mark.parametrize("hot", [None, 7, -2, 200])
def test_merkle_hot_ids(spark, hot):
    """A third of all rows without id or with one id: the order goes on by the texts' hashes, over several chunks."""
    texts = [f"text {i}. " + "x" * (i % 9) for i in range(240)] + [None, "", "long. " * 20_000]
    ids = [hot if i % 3 == 0 else i for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(ids, texts)), "id long, text string").repartition(6).select("id", F.coalesce("text", F.lit("")).alias("text"))
    got = merkle.next_by_id(rows.withColumn("tie", F.xxhash64("text")), ["text"]).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(((i, t or "") for i, t in zip(ids, texts)), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = [(i, t, n) for (i, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted(((r["id"], r["text"], r["next_text"]) for r in got), key=str) == sorted(want, key=str)
    assert merkle.compare_with_edit(rows.withColumnRenamed("id", "doc_id")).count() == len(texts)


def test_merkle_differences(spark):
    texts = [f"line {i}. and more. of it." for i in range(40)]
    changed = [*texts]
    changed[17] = "line 17. and less. of it."
    df = spark.createDataFrame([("\n".join(texts), "\n".join(changed))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    row = merkle.with_difference(merkle.with_difference(df, "fa", "fb", "d"), "fa", "fa", "same").first()
    sections = brute_tree("\n".join(texts)).partition(":")[2].split(";")
    counts = [len(s.split("/")) for s in sections]
    section = next(i for i in range(len(counts)) if sum(counts[: i + 1]) > 17)
    assert row["same"] is None and tuple(row["d"]) == (section, 17 - sum(counts[:section]), 2, 1)


def test_merkle_keeps_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a. b", "x", "y", "z")], "doc_id long, text string, _text string, _leaves string, fingerprint string")
    out = merkle.merkle_fingerprints(df)
    assert out.columns == [*df.columns, "_fingerprint"] and out.first()[:5] == (1, "a. b", "x", "y", "z") and out.first()["_fingerprint"] == brute_tree("a. b")


def test_flow_of_many_sources_apart():
    patterns = {frozenset({i}): 10 + i % 7 for i in range(4000)} | {frozenset(): 5, frozenset({5000, 5001}): 8}
    flow = mixing.route(patterns, {i: 15 for i in range(4000)} | {5000: 3, 5001: 50}, 3)
    assert all(flow[frozenset({i}), i] == 15 for i in range(4000))
    assert flow[frozenset({5000, 5001}), 5000] + flow[frozenset({5000, 5001}), 5001] == 24
    assert [len(p) for p in mixing.parts({frozenset("ab"): 1, frozenset("bc"): 1, frozenset("d"): 1, frozenset(): 1})] == [2, 1]


def test_water_fill():
    got = mixing.water_fill({"a": 10, "b": 100, "c": 0}, {"a": 1, "b": 1, "c": 1}, 3)
    assert got == {"a": 30.0, "b": 80.0, "c": 0.0}
    assert mixing.water_fill({}, {}, 3) == {}


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(15):
        patterns = {frozenset(p): rng.randrange(0, 5) for p in ({"a"}, {"b"}, {"a", "b"})}
        quotas = {"a": rng.randrange(0, 9), "b": rng.randrange(0, 9)}
        flow = mixing.route(patterns, quotas, 3)
        cost = lambda p, n: sum(k * min(max(0, n - k * patterns[p]), patterns[p]) for k in range(3))
        total = lambda f: (sum(f.values()), -sum(cost(p, sum(v for (q, _), v in f.items() if q == p)) for p in patterns))
        keys = [(p, s) for p in patterns for s in sorted(p)]
        best = (-1, 0)
        for n in product(*(range(min(3 * patterns[p], quotas[s]) + 1) for p, s in keys)):
            f = dict(zip(keys, n))
            if all(sum(v for (p, _), v in f.items() if p == q) <= 3 * patterns[q] for q in patterns) and all(sum(v for (_, s), v in f.items() if s == t) <= quotas[t] for t in quotas):
                best = max(best, total(f))
        assert total(flow) == best


def test_mixing(spark):
    texts = corpus(n=300)
    table = docs(spark, texts)
    rows = mixing.mix(table, mixing.by_source(table)).collect()
    again = mixing.mix(table.repartition(3), mixing.by_source(table)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 300
    sizes = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    total, want = Counter(), Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        want[source[r["doc_id"]]] += r["taken"]
    ordered = sorted(total, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill(dict(total), {s: i % 3 + 1 for i, s in enumerate(ordered)}, 3)
    for r in rows:
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
    for s in ordered:
        assert want[s] == int(targets[s] + 0.5)
    mixed = mixing.apply_mix(table, mixing.by_source(table))
    assert mixed.columns == table.columns
    assert mixing.mix(docs(spark, []), mixing.by_source(table)).count() == 0


def test_mixing_large_documents(spark):
    """A source whose documents are larger than its target gets it by a part of one."""
    table = spark.createDataFrame([(1, "w " * 40, "a"), (2, "w " * 30, "b"), (3, "w " * 8, "c")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in mixing.mix(table, mixing.by_source(table)).collect()}
    assert [rows[i]["taken"] for i in (1, 2, 3)] == [18, 36, 24] and [rows[i]["target"] for i in (1, 2, 3)] == [18.0, 36.0, 24.0]
    with pytest.raises(ValueError, match="more than 2 membership patterns"):
        mixing.mix(table, mixing.by_source(table), max_patterns=2)


def test_mixing_overlapping_sources(spark):
    """Pattern flows of documents in two sources against an exhaustive search of the cheapest flow."""
    sizes = {("a",): 2, ("b",): 3, ("a", "b"): 4}
    table = spark.createDataFrame([(i, "w " * n, list(p)) for i, (p, n) in enumerate(sizes.items())], "doc_id long, text string, of array<string>")
    rows = {r["doc_id"]: r for r in mixing.mix(table, F.col("of"), weight_of=lambda sources: {"a": 1, "b": 3}).collect()}
    total = {"a": 6, "b": 7}
    targets = mixing.water_fill(total, {"a": 1, "b": 3}, 3)
    quota = {s: int(t + 0.5) for s, t in targets.items()}
    best = None
    for x, y, u, v in product(range(7), range(10), range(13), range(13)):
        if x + u <= quota["a"] and y + v <= quota["b"] and u + v <= 12:
            passes = [max(0, n - k * s) for n, s in ((x, 2), (y, 3), (u + v, 4)) for k in (1, 2)]
            best = max(best or (-1, 0), (x + y + u + v, -sum(passes)))
    taken = [rows[i]["taken"] for i in range(3)]
    assert (sum(taken), -sum(max(0, n - k * s) for n, s in zip(taken, sizes.values()) for k in (1, 2))) == best
    assert [rows[i]["source_size"] for i in range(3)] == [6, 7, 13]


def test_apply_mix_odd_rows(spark):
    """Rows that repeat an id keep their own takes; null ids, null texts and columns of names used inside stay whole."""
    rows = [(1, "a b", "s"), (1, "c d e f", "s"), (None, "g", "s"), (2, None, "t"), (3, "h i", "t"), (3, "h i", "t"), (3, "h i", "s"), (4, "j k l m n o", None)]
    table = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, id int, times int")
    mixed = mixing.apply_mix(table, mixing.by_source(table))
    taken = mixing.mix(table, mixing.by_source(table), in_part=False).collect()
    words = lambda t: len((t or "").split())
    assert mixed.columns == table.columns
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[r["doc_id"], words(r["text"])] += words(r["text"])
    for r in taken:
        want[r["doc_id"], r["size"]] += r["taken"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert +got == +want and got[2, 0] == 0 and mixed.where("text is null").count() == 1


URLS = ["https://a.org/x", "http://spam.example.org/en/1?q=1", "http://Example.ORG/es/2#f", "http://example.org/es", "https://x.com/fr/", "https://x.com/de/9", "https://x.com/en/9", "http://net/", "org", "", None, "http://org", "http://notorg/a", "x://u.org?z/", "ftp://b.net/a%20b/\u00e9", "http://comm.com/fr/a", "http://xorg/", "http://cheap.example.com/de/12", "http://good.example.com/fr/12"]


def brute_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    host, path = "".join(c.lower() if c.isascii() else c for c in host), tail[:end]
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1:] if fits else (None, None)


def brute_fold(text, order, wide):
    if wide:
        kind = lambda c: c if c.isascii() and "!" <= c <= "~" and c != "^" else "*" if c.isascii() else "\u00aa" if c.isalpha() else "\u00b9" if c.isnumeric() else "\u00a4"
    else:
        kind = lambda c: "0" if c in "0123456789" else c.lower() if c.isascii() and c.lower() in urls.ALPHABET[:-2] else "*"
    return "^" * order + "".join(map(kind, text)) + "^"


class BruteModel:
    """Witten-Bell by the definition, over whole grams."""

    def __init__(self, grams, signs):
        self.grams, self.signs = grams, signs

    def p(self, gram):
        n = sum(k for g, k in self.grams.items() if g.endswith(gram))
        if len(gram) == 1:
            return (n + 1) / (sum(self.grams.values()) + self.signs)
        after = Counter()
        for g, k in self.grams.items():
            if g[-len(gram) : -1] == gram[:-1]:
                after[g[-1]] += k
        low = self.p(gram[1:])
        return (n + len(after) * low) / (sum(after.values()) + len(after)) if after else low


@pytest.mark.parametrize(("order", "wide"), [(2, False), (4, True)])
def test_urls_against_brute_force(spark, order, wide):
    rng = random.Random(6)
    table = [*URLS, *(rng.choice([u for u in URLS if u]) + str(rng.randrange(99)) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(table)), "page_id long, url string").selectExpr("page_id", "url", "1 as host", "2 as gram", "3 as held_out")
    got = {r["page_id"]: r for r in urls.judge_urls(df, order=order, wide=wide).collect()}
    texts = [brute_fold(brute_url(u)[0] + brute_url(u)[1], order, wide) for u in table]
    held = [xxhash.xxh64_intdigest(t.encode(), 42) % 2**64 for t in texts]
    held = [(h - (1 << 64) if h >> 63 else h) % urls.HELD_OUT == 0 for h in held]
    grams_of = lambda t: [t[i : i + order + 1] for i in range(len(t) - order)]
    counts = {v: Counter() for v in ("allow", "block")}
    for u, t, out in zip(table, texts, held):
        if (verdict := brute_url(u)[2][1]) and not out:
            counts[verdict].update(grams_of(t))
    models = {v: BruteModel(c, len(urls.WIDE) if wide else urls.SIGNS) for v, c in counts.items()}
    ratio = {}
    for g in {g for t in texts for g in grams_of(t)}:
        ratio[g] = math.log(models["allow"].p(g)) - math.log(models["block"].p(g))
    scores = [sum(ratio[g] for g in grams_of(t)) / (len(t) - order) for t in texts]
    by_class = {v: [s for u, s, out in zip(table, scores, held) if out and brute_url(u)[2][1] == v] for v in counts}
    assert all(by_class.values()) and sum(map(len, by_class.values())) < sum(held) + 1
    mean, spread = ({v: f(x) for v, x in by_class.items()} for f in (statistics.fmean, lambda x: statistics.pstdev(x) + 1e-9))
    threshold = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    n = min(map(len, by_class.values()))
    threshold *= n / (n + urls.CAUTION)
    told = Counter()
    for i, u in enumerate(table):
        host, path, (rule, verdict) = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["held_out"]) == (host, path, rule, held[i]), u
        assert got[i]["score"] == pytest.approx(scores[i], abs=1e-9)
        if abs(scores[i] - threshold) > 1e-6:
            by_model = "block" if scores[i] < threshold else "allow"
            assert got[i]["verdict"] == (verdict or by_model) and got[i]["model_verdict"] == by_model
            told[verdict is None, by_model] += 1
    assert len(told) >= 3
    assert urls.judge_urls(df.where("page_id < 0")).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df.where("url = 'http://net/'")).collect()} == {"allow"}


def test_urls_learn_long_contexts(spark):
    """Two words of the same triples of signs, told apart by longer contexts; and grams joined by hash as those that are sent to all."""
    allow, block = "xyaxybxy", "xybxyaxy"
    table = [f"http://x.com/{'fr' if i % 2 else 'de'}/{allow if i % 2 else block}" for i in range(60)] + [f"http://x.net/{allow}", f"http://x.net/{block}"]
    table += [f"http://{c}.com/{'fr' if i % 2 else 'de'}/{allow if i % 2 else block}" for i, c in enumerate("abcdefghijklmnopqrst")]
    df = spark.createDataFrame(list(enumerate(table)), "page_id long, url string")
    judge = lambda **how: {r["page_id"]: r for r in urls.judge_urls(df, **how).collect()}
    long, joined, short = judge(order=5), judge(order=5, often=20), judge(order=2, wide=False)
    assert (long[60]["rule"], long[60]["verdict"], long[61]["verdict"]) == (None, "allow", "block")
    assert [joined[i]["score"] for i in range(62)] == pytest.approx([long[i]["score"] for i in range(62)])
    assert long[60]["score"] - long[61]["score"] > short[60]["score"] - short[61]["score"] + 0.1
    # By hand: each context of the allowed word's last sign has one sign after it in its class, and none of four signs in the other.
    grams = spark.createDataFrame([("bcdda", 30, 0), ("acddb", 0, 30)], "gram string, allow long, block long")
    ratio = {r["gram"]: r["ratio"] for r in urls.log_ratios(grams, 4, urls.SIGNS).collect()}
    p, q = 31 / (30 + urls.SIGNS), 1 / (30 + urls.SIGNS)
    for k in range(1, 5):
        p, q = (30 + p) / 31, q / 31 if k < 4 else q
    assert ratio["bcdda"] == pytest.approx(math.log(p / q)) == -ratio["acddb"]


def test_urls_keep_digits_and_capitals_apart(spark, tmp_path):
    """The query's scores of pages that differ only in a digit, a capital or a class outside ASCII; the blocked and the allowed differ in a digit alone."""
    from orderlens.llm.queries import queries

    table = [f"http://{h}.example.org/en/{n}" for h in "ab" for n in (1, 11, 12, 2, 22, 23)] + ["http://a.net/en/11", "http://a.net/en/22", "http://a.net/en/X", "http://a.net/en/x", "http://a.net/\u00e9^ \u0663\u20ac", "http://a.net/\u0436^ \u0664\u20ac"]
    spark.createDataFrame(list(enumerate(table)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries()["op9_url_filter"](spark, str(tmp_path)).collect()}
    assert {got[i]["verdict"] for i in (0, 1, 2)} == {"block"} and {got[i]["verdict"] for i in (3, 4, 5)} == {"allow"}
    assert (got[12]["verdict"], got[13]["verdict"]) == ("block", "allow") and got[12]["score"] < got[13]["score"]
    assert got[16]["score"] == pytest.approx(got[17]["score"])
    text = spark.createDataFrame([("h", "/aZ09^ \u00e9\u0663\u20ac\u00aa")], "host string, path string").select(urls.folded(F.col("host"), F.col("path"), 2, True)).first()[0]
    assert text == "^^h/aZ09**\u00aa\u00b9\u00a4\u00aa^" and set(text) <= set(urls.WIDE) and len(set(urls.WIDE)) == len(urls.WIDE) == 97


def test_kept_tables_can_be_released(spark):
    from orderlens.llm import common

    common.release(spark)
    df = common.keep(spark.range(3))
    assert df.count() == 3 and common.release(spark) == 1 and common.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|cannot"):
        df.collect()


def test_merkle_likeness_of_texts_without_signs(spark):
    """Two halves of a long text without punctuation; and the whole table: half an edit shows as about half the leaves."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(n))
    df = spark.createDataFrame([(2, words(20_000)), (1, words(20_000)), (0, "x" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.compare_with_edit(df).collect()}
    assert abs(got[2]["near_edited"] - 0.5) < 0.05 and got[2]["near_next"] < 0.05 and got[0]["near_edited"] > got[0]["near_next"]
    table = merkle.compare_with_edit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 100")
    told = table.agg(F.count_if(F.expr("near_edited < 0.3")).alias("low"), F.count_if(F.expr("near_edited <= near_next")).alias("same"), F.count(F.lit(1)).alias("n")).first()
    assert told["same"] == 0 and told["low"] <= 0.02 * told["n"]
