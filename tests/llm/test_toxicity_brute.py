"""Toxicity scores against a scan of every place by plain string comparison, and the fit over an odd table."""

import math
import random

from pyspark.sql import functions as F

from orderlens.llm import toxicity

TERMS = {"dolt": 2.0, "grubber*": 3.0, "wretch": 1.5, "creep*": 1.0, "b": 0.5}
HELD = ("not a creep", "wretch of old")


def brute_score(text, lexicon):
    """Each place and term by comparison; edges are letters of the text as written, with letters folded one by one."""
    plain = "".join(toxicity.LETTERS.get(ord(c), c) if ord(c) > 127 else c for c in (c.lower() if len(c.lower()) == 1 else c for c in text))
    signs = "".join(toxicity.SIGNS.get(ord(c), c) for c in plain)
    signs_folded = lambda t: "".join(toxicity.SIGNS.get(ord(c), c) for c in t)
    hits, excused = set(), []
    for look in (plain, signs):
        for start in range(len(look)):
            if start and plain[start - 1].isalpha():
                continue
            for term in lexicon.weights:
                letters = term.rstrip("*")
                end = start + len(letters)
                if look[start:end] == letters:
                    if term.endswith("*") and look[end : end + 1].isalnum() or not term.endswith("*") and not plain[end : end + 1].isalpha():
                        hits.add((start, end, term))
            for phrase in lexicon.exceptions:
                end = start + len(phrase)
                if look[start:end] == signs_folded(phrase) and not plain[end : end + 1].isalpha():
                    excused.append((start, end))
    total = sum(lexicon.weights[t] for a, b, t in hits if not any(x <= a and b <= y for x, y in excused))
    strength = total / math.log2(2 + text.count(" ")) if total else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.slope * strength + lexicon.offset))))


def test_scores_against_brute_force(spark):
    rng = random.Random(3)
    lexicon = toxicity.Lexicon(TERMS, 2.0, -2.5, HELD)
    words = ["dolt", "D0LT", "dоlt", "grubbers", "Grubber", "wretch", "wretched", "creepy", "creep", "not a creep", "not a creeper", "wretch of old", "b", "8", "fine", "day", "xdolt", "dolt2", "Ｄｏｌｔ", "$", "café", "İx"]
    texts = ["", *(rng.choice([" ", "-", ". ", ""]).join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(df, lexicon).collect():
        assert math.isclose(r["score"], brute_score(r["text"], lexicon), rel_tol=1e-12), r["text"]


def test_fit_over_odd_rows(spark):
    rows = [(i, f"plain words {i} of a day" if i % 2 else f"zorgle fool number {i}") for i in range(80)] + [(None, "zorgle"), (None, None), (5, None), (6, ""), (7, "zorgle " * 50_000), (3, "plain words 3 of a day")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, label int, key int").repartition(4)
    labels = spark.createDataFrame([(i, 1, 1 - i % 2 if i != 9 else None) for i in range(80)] + [(None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, lexicon)
    told = {r["text"]: r["score"] for r in scored.where("text is not null").collect()}
    assert scored.count() == len(rows) and told["zorgle fool number 2"] > 0.5 > told["plain words 3 of a day"]
    again = toxicity.fit(docs.repartition(7), labels)
    assert again.weights == lexicon.weights and math.isclose(again.slope, lexicon.slope, rel_tol=1e-9)
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, none).where(F.col("score") >= 0.3).count() == 0
