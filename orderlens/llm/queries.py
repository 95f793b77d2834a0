"""The queries opN_<name>: each operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, licenses, merkle, mixing, pages, pii, piece_bpe, simhash, substring, toxicity, urls, whitening
from .common import WORD, read, release


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep_largest=True)


def op2_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(read(spark, sf_dir, "documents"), piece_model_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.by_source(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edit(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read(spark, sf_dir, "documents"), key=pii.key_of(spark))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(read(spark, sf_dir, "pages"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(read(spark, sf_dir, "conversations")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_piece_bpe, op3_mixing, op4_toxicity, op5_merkle, op6_substring_dedup, op7_pii, op8_simhash, op9_url_filter, op10_licenses,
        op11_html, op12_conversations, op13_whitening,
    )
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: Windows by brute force: the words of each, joined.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d WHERE len(words) >= 50) x),
earliest AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
hit AS (SELECT DISTINCT w.doc_id, unnest(range(w.pos, w.pos + 50)) AS pos FROM w JOIN earliest USING (h) WHERE w.doc_id > earliest.least),
n AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM d),
kept AS (SELECT n.doc_id, array_to_string(list(n.word ORDER BY n.pos), ' ') AS stay, count(*) AS n_stay FROM n ANTI JOIN hit ON n.doc_id = hit.doc_id AND n.pos = hit.pos GROUP BY n.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_stay, 0))::BIGINT AS n_removed, sha256(coalesce(stay, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_substring_dedup": OP6_SQL}


__all__ = ["oracle_sql", "piece_model_path", "queries", "release"]
