"""A training-text pipeline over the documents table: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudspark.llm import decontam, lines, packing, quality, simhash
from fraudspark.llm.common import stored, table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a probability of good quality of 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), accept=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are on ten sources or more, and those of 50 words on two, but for their first place; documents left blank go."""
    return lines.drop_furniture(docs, site="source", least_sites=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies: five-word shingles, exact set similarity 0.8 or more."""
    return simhash.keep_one(docs, simhash.verified_documents(docs, similarity=0.8, words_per_shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages of ten words or more; documents that are mostly benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, most_covered=0.5)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), size=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, fingerprints and the tokenizer are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
