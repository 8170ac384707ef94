"""The corpus pipeline's stages: quality, near duplicates, benchmark passages, personal data, BPE.

Each reads what its predecessor kept; all but the last keep the columns of ``documents``.  Null, empty, repeated and very long texts are treated as the operators
say: quality rejects texts without content, repeated rows of one id stay or go together, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm import bpe, decontamination, jaccard, pii, quality
from estatelens.llm.common import settle, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on those labelled good, rejects."""
    return quality.keep_good(docs, table(small_batches(spark), sf_dir, "labels").where("quality = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each text's ids and of what they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("personal_data", without_personal_data), ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back, so a lost executor costs part of one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
