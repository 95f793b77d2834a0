"""Every operator over the same odd table: null ids and texts, repeated and empty rows, a very long text, ties, and columns of names used inside; and over an empty one."""

import hashlib
from collections import Counter

import pytest

from orderlens.llm import exact_dedup, licenses, merkle, mixing, pii, piece_bpe, shingles, simhash, substring, toxicity, urls
from orderlens.llm.queries import piece_model_path

NAMES = ["text_to_score", "score", "mark", "check", "key", "size", "pattern", "fp", "hashes", "node", "tie", "own", "part", "fingerprint", "start", "words", "found", "kept", "host", "path", "rule", "gram", "n"]
LONG = " ".join(f"w{i % 5003}" for i in range(150_000))
ROWS = [(1, "one two three."), (1, "one two three."), (1, "other."), (2, None), (3, ""), (None, "one two three."), (None, None), (4, LONG), (5, LONG), (6, " \n\t "), (7, "a\u00a0b \U0001f600 caf\u00e9"), (-8, "ONE TWO THREE.")]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, None if n % 4 == 0 else f"s{n % 3}", *range(len(NAMES))) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES)).repartition(5)


def lexicon(spark, docs):
    return toxicity.Lexicon({"other": 3.0}, 5.0, -3.0)


ROW_FOR_ROW = {
    "op1": lambda spark, docs: exact_dedup.exact_dedup(docs),
    "op2": lambda spark, docs: piece_bpe.encode_documents(docs, piece_model_path()),
    "op3": lambda spark, docs: mixing.mix(docs, mixing.by_source(docs)),
    "op3 whole": lambda spark, docs: mixing.mix(docs, mixing.by_source(docs), in_part=False),
    "op4": lambda spark, docs: toxicity.score(docs, lexicon(spark, docs)),
    "op5": lambda spark, docs: merkle.compare_with_edit(docs),
    "op5 plain": lambda spark, docs: merkle.merkle_fingerprints(docs),
    "op6": lambda spark, docs: substring.substring_dedup(docs),
    "op7": lambda spark, docs: pii.pseudonyms(docs),
    "op7 mask": lambda spark, docs: pii.mask(docs),
    "op8": lambda spark, docs: simhash.near_components(docs),
    "op10": lambda spark, docs: licenses.scan_licenses(docs),
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_one_row_for_each_row(spark, table, name):
    out = ROW_FOR_ROW[name](spark, table)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in ROWS)
    empty = ROW_FOR_ROW[name](spark, table.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_texts_with_one_text_have_one_result(spark, table):
    """A null text is the empty text everywhere; equal texts have equal results whatever their ids."""
    text = {"": hashlib.sha256(b"").hexdigest()}
    assert {r["text_sha256"] for r in exact_dedup.exact_dedup(table).collect() if r["doc_id"] in (2, 3)} == set(text.values())
    tokens = {r["doc_id"]: r["ids_sha256"] for r in piece_bpe.encode_documents(table, piece_model_path()).collect()}
    assert tokens[2] == tokens[3] and tokens[4] == tokens[5]
    prints = {r["doc_id"]: r["fingerprint"] for r in merkle.compare_with_edit(table).collect()}
    assert prints[2] == prints[3] and prints[4] == prints[5] != prints[2]
    fps = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_components(table).collect()}
    assert fps[2] == fps[3] == fps[6] == ("0" * 16, 2) and fps[4] == fps[5] and fps[-8][1] == -8
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.substring_dedup(table).collect()}
    assert cut[4] == (150_000, 0) and cut[5] == (150_000, 150_000) and cut[2] == cut[3] == cut[6] == (0, 0)


DROPS = {
    "exact": lambda docs: exact_dedup.drop_copies(docs),
    "simhash": lambda docs: simhash.drop_near_copies(docs),
    "shingles": lambda docs: shingles.drop_near_copies(docs),
}


@pytest.mark.parametrize("name", DROPS)
def test_drops_keep_columns_and_one_of_each_group(spark, table, name):
    out = DROPS[name](table)
    assert out.columns == table.columns
    texts = Counter((r["text"] or "").strip().lower() for r in out.collect())
    assert texts["one two three."] == texts["other."] == texts[LONG] == 1 and 1 <= texts[""] <= 2
    assert DROPS[name](table.limit(0)).count() == 0


def test_url_table(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (2, ""), (3, "x://"), (4, "http://" + "a" * 50_000 + ".com/de/" + "b/" * 20_000), (5, "http://b.com/fr/1")]
    df = spark.createDataFrame([(i, u, *range(len(NAMES))) for i, u in rows], "page_id long, url string, " + ", ".join(f"{n} int" for n in NAMES))
    got = urls.judge_urls(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in rows) and {r["verdict"] for r in got if r["page_id"] == 4} == {"block"}
    assert {(r["host"], r["path"], r["rule"]) for r in got if r["page_id"] in (None, 2, 3)} == {("", "", None)}
    assert urls.judge_urls(df.limit(0)).count() == 0
