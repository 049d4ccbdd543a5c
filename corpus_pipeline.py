"""Corpus pipeline: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes the documents that the one before it kept. Its result is written to the shared folder and read again, so
plans stay short and a lost executor costs its tasks only. Every stage but the last returns the columns it was given.
SQL cannot state the classifiers, so the pipeline has no statement; tests hold it against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import common, decontaminate, mixing, near_duplicates, pii, quality

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates (shingles of five words, similarity of 0.8 or more)."""
    return near_duplicates.keep_first(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of the benchmark cover less than a twentieth."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


#: Token shares by (quality, toxic) after mixing; what the first stage let through of poor text is not raised again.
TARGETS = {(1, 0): 0.99, (1, 1): 0.01, (0, 0): 0.0, (0, 1): 0.0}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rates toward the target shares of the domains."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"), TARGETS, carry=True)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
