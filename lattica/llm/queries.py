"""The registered query of each corpus operator, with its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import ball_tree, bpe, minhash, multi_index, packing, quality, suffix_array, suffix_tree, toxicity, warc
from lattica.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=())
    return found.select("doc_id", "held_out", "score", "predicted", "whole_llr", "passage_llr")


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.approximate_top_k(table(spark, sf_dir, "embeddings"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.digests(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class: the smallest doc_id of the documents that it is linked to."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_toxicity, op2_ball_tree, op3_quality, op4_multi_index, op5_suffix_array, op6_packing, op7_suffix_tree, op8_bpe, op9_warc, op10_minhash)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


ORACLE = {
    "op2_ball_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
        f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY n, h) AS first_id FROM d),
        bits AS (
            SELECT page_id, n, first_id, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda b:
                (instr('0123456789abcdef', substr(h, CAST((5 * i + b) // 4 + 1 AS INTEGER), 1)) - 1) // CAST(pow(2, 3 - (5 * i + b) % 4) AS INTEGER) % 2 * CAST(pow(2, 4 - b) AS INTEGER)))::INTEGER, 1)), '') AS digest
            FROM f
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM bits
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
