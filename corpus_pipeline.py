"""A corpus cleaned and encoded: toxic documents, near-duplicates and benchmark leaks go, the rest becomes token ids."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from reviewrank.llm import forced_bpe, near_dedup, spaced_seeds, toxicity  # noqa: E402
from reviewrank.llm.common import bound_arrow, read  # noqa: E402
from reviewrank.session import shared_dir  # noqa: E402


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the model learned from the labels."""
    bound_arrow(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bound_arrow(spark)
    return near_dedup.drop_near_duplicates(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    bound_arrow(spark)
    return spaced_seeds.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    bound_arrow(spark)
    return forced_bpe.round_trip(docs)


STAGES = [("toxicity", not_toxic), ("near-dedup", one_of_each), ("decontamination", not_leaked), ("encoding", encoded)]

#: SimHash votes, learned lexicons and byte-pair merges are beyond SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
