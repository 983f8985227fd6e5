"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Every stage works on the rows that the stage before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import decontamination, packing, pii, quality, simhash
from tallyworks.llm.common import checkpoint, read_table, remove_folder, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five-word Jaccard similarity of 0.8 or more): the one with the smallest id."""
    return simhash.deduplicate_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{n}`") for n in docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again as the next one's.

    Null and blank texts fail the quality rules; rows with a null id that pass them stay through all stages; of repeated
    rows one stays. An empty table gives an empty result, and texts have any length. Stages keep columns of any names. Written stages are removed,
    also if one fails.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
        return checkpoint(docs)
    finally:
        remove_folder(spark, folder)


#: Fingerprints, certified cutoffs and tokenization are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
