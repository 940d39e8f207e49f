"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontamination, hard_negatives, jaccard_join, license_scan, line_dedup, oracles, packing, quality_classifier, quality_rules, secret_scan, spelling, suffix_dedup, token_counts
from tessera.llm.common import documents


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left."""
    return line_dedup.dedup_documents(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of each leak, with how much of the item the document covers and how many slots were exchanged."""
    return decontamination.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, family, confidence, similarity, confirmed of each paragraph that names a licence."""
    return license_scan.license_scan(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bad_probability, kept."""
    docs = documents(spark, sf_dir)
    return quality_classifier.scored(docs.select("doc_id", "text"), quality_classifier.fit(docs)).select("doc_id", "bad_probability", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return packing.packed(packing.pieces(documents(spark, sf_dir), ids=False))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

#: SQL where it can express a method's result; tests/llm holds the others against the libraries or brute force.
ORACLES: dict[str, str] = dict(oracles.ORACLES)
