"""The corpus pipeline: five stages, each one operator, over the documents table.

Every stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of the documents table.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import common, decontaminate, jaccard, mixing, pii, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labels of all but one fold."""
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(common.fold("doc_id", 4) != 2)
    return toxicity.remove_toxic(docs, toxicity.fit(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return jaccard.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by the benchmark."""
    return decontaminate.remove_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; all documents stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents out to the sources' target weights."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", remove_benchmark),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: Three of the stages are learnt or searched; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table of `sf_dir`."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(common._remove, spark, folder)
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        common.release()
        docs = spark.read.parquet(path)
    return docs
