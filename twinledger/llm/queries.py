"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, licenses, neardup, packing, pii, quality, runs, sentencepieces, tokencounts, urlfilter, variants, warc
from .storage import in_small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def misspelt(doc_id: int | None, word: str) -> str:
    """A text's word as op11 counts it: one in about 199 lacks a code point."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents"), edit=misspelt))


def repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of n words that op12 plants in one text of ten: from some place on, the same words over and over."""
    h = crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    i, p = np.arange(n), 1 + (n - a) // (3 + h // 10 % 8)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digested(runs.without_runs(table(spark, sf_dir, "documents"), arranged=repeated))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.round_trip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_writer": """
            WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
            g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
            SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
                CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN top != page_id THEN top END AS refers_to
            FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000"""
    }
