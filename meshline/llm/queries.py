"""The queries of the corpus operators: thin digests of what they return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshline.llm import bpe, hilbert, html_tree, langid_cnn, license_scan, quality_lr, simhash_vp, spaced_seed, token_orc, warc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid_cnn.identify(docs, langid_cnn.fit_language(docs))


def op4_quality_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_lr.score_quality(docs, quality_lr.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents")).drop("hilbert")


def op10_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_orc, op2_license_scan, op3_langid_cnn, op4_quality_lr, op5_bpe, op6_warc, op7_simhash_vp, op8_html_tree, op9_hilbert, op10_spaced_seed, pipeline)}

#: Base 32 of a SHA-1 in hex: five hex digits are four of its digits.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')"

#: The other hashes, models and encoders are beyond SQL here; tests/llm holds each query against a brute-force version.
ORACLES: dict[str, str] = {
    "op6_warc": (
        "WITH k AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages) "
        f"SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM k"
    )
}
