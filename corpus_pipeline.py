"""A training corpus from the documents table: quality, near duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Its result is written and
read again before the next begins, so a lost executor costs no more than one stage.

Every stage takes rows as they come: a null text is an empty one, rows with a null or repeated doc_id stay rows of their
own (near_dedup keeps one row of each class of texts), all columns go through, and an empty table gives an empty one. An
empty text is judged like any other by quality, is like equal texts alone in near_dedup, holds no passage and no personal
data, and has no words for mixing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandmark.llm import decontamination, mixing, near_dedup, pii, quality
from strandmark.llm.common import shared_dir, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; labels of held-out rows are not learnt from."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return near_dedup.keep_one(docs)


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With marks in the place of personal data."""
    return pii.mask(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, numbered by copy."""
    return mixing.emitted(docs)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", unleaked_documents),
    ("pii", masked_documents),
    ("mixing", mixed_documents),
]

#: SQL can express neither the classifier nor the near-duplicate classes; tests/llm checks each stage by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
