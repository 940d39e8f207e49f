"""The corpus pipeline: staged filters and edits over ``documents``, each stage one of the corpus operators.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, whatever else these may be named.

Defined cases: rows without an id, with null or empty texts and very long ones pass every stage, as no operator finds a fault in them; rows of equal
ids are judged by their texts in the first two stages, together in the next two (the near-duplicate class and the contamination of an id); an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontamination, jaccard_join, line_dedup, quality_classifier
from tessera.llm.common import documents, sized_semi_join, staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, trained on this input, does not reject."""
    scored = quality_classifier.scored(docs, quality_classifier.fit(docs), names=("__bad", "__kept"))
    return scored.filter("__kept").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier; a document goes if none of its words are left, and it had some."""
    out = line_dedup.dedup_documents(docs, counts=("__lines", "__removed")).filter("__removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class."""
    gone = staged(jaccard_join.jaccard_classes(docs).filter("component_id < doc_id").select(F.col("doc_id").alias("__id")).distinct(), "near-copies")
    return sized_semi_join(docs.withColumn("__id", F.col("doc_id").cast("long")), gone, "left_anti", on="__id").select(*docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of what is left."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL cannot express the classifier, SimHash, Jaccard classes, the templates or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
