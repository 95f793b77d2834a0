"""The corpus pipeline against plain Python, stage by stage, each on its own input."""

import hashlib
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import mixing, toxicity
from orderlens.llm.common import keep, read
from orderlens.llm.queries import piece_model_path

from .test_dedup import LOWER, odd_rows
from .test_shingles import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [read(spark, SF, "documents")]
    for _, f in corpus_pipeline.STAGES:
        out.append(keep(f(spark, out[-1], SF)))
    return [(df.columns, df.collect()) for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "SentencePiece"]
    assert all(c == stages[0][0] for c, _ in stages[1:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_toxicity_stage(spark, stages):
    lexicon = toxicity.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    assert {r["doc_id"] for r in stages[1][1]} == {r["doc_id"] for r in stages[0][1] if lexicon.score(r["text"] or "") < 0.3}


def test_exact_stage(stages):
    groups = defaultdict(list)
    for r in stages[1][1]:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2][1]) == sorted(max(g) for g in groups.values())


def test_near_stage(stages):
    """Groups by all pairs of five-word shingle sets of similarity 0.8 or more; op8's three bits are that query's contract, not the stage's."""
    rows = sorted(stages[2][1], key=lambda r: r["doc_id"])
    components = brute([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in stages[3][1]) == [r["doc_id"] for i, r in enumerate(rows) if components[i] == i]


def test_stages_with_odd_rows(spark):
    """Repeated rows, null ids and texts, an empty table, and columns of names used inside."""
    table = odd_rows(spark).withColumn("source", F.when(F.col("doc_id") == 1, "a"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.count() > 0
        assert stage(spark, table.limit(0), SF).count() == 0
    tokens = corpus_pipeline.stage_tokens(spark, table, SF)
    assert tokens.count() == 12 and corpus_pipeline.stage_tokens(spark, table.limit(0), SF).count() == 0


def test_mixing_stage(stages):
    words = lambda r: len((r["text"] or "").encode().split())
    before = {r["doc_id"]: r for r in stages[3][1]}
    times = Counter(r["doc_id"] for r in stages[4][1])
    assert set(times) <= set(before) and max(times.values()) <= 3 and all(before[r["doc_id"]] == r for r in stages[4][1])
    sizes, taken = Counter(), Counter()
    for r in before.values():
        sizes[r["source"]] += words(r)
        taken[r["source"]] += words(r) * times[r["doc_id"]]
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(ordered)}, 3)
    for s in ordered:
        fewest = min(times[i] for i, r in before.items() if r["source"] == s)
        smallest = min(words(r) for i, r in before.items() if r["source"] == s and times[i] == fewest)
        assert -1 <= targets[s] - taken[s] <= max(0.05 * targets[s], smallest), s


def test_tokens_stage(spark, stages):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=piece_model_path())
    want = []
    for r in stages[4][1]:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, stages[5][1])) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
