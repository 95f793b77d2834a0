"""A corpus pipeline over ``documents``: toxic documents go, then exact and near copies, then the rest is mixed by source and tokenized.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the last
returns doc_id, n_tokens and the digests of the ids and of the decoded text, a row for each time that the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import exact_dedup, mixing, piece_bpe, shingles, toxicity
from orderlens.llm.common import KEPT, keep, read, release
from orderlens.llm.queries import piece_model_path


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, as in the query op1."""
    return exact_dedup.drop_copies(docs, keep_largest=True)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles of similarity 0.8 or more the smallest doc_id stays: a wide SimHash and its index of positions propose, the shingle sets decide. op8's three bits are for that query."""
    return shingles.drop_near_copies(docs, size=5, similarity=0.8)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs, mixing.by_source(docs))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(docs, piece_model_path())


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("SimHash near-dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("SentencePiece", stage_tokens),
]

#: Hash order, learned weights and merges aren't SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), list(KEPT)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
            # Once a stage is written, the tables behind it are read by nothing.
            release(spark, [p for p in KEPT if p not in before and p != docs.kept_at])
    return docs
