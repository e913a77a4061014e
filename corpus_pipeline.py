"""A training-data pipeline over ``documents``: quality, exact copies, near copies, mixture, subword ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null texts are empty, extra columns pass all stages but the last, and an
empty table gives an empty result; what each stage does with nulls, ties and repeated rows is
its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, mixing, near_dedup, pieces, quality
from larkspur.llm.common import checkpointed, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep_good(docs, net)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_exact(docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.sample_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids."""
    return pieces.encode_texts(docs, pieces.Vocabulary(), keep=("doc_id", "lang", "source"))


STAGES = [("quality", good), ("exact_dedup", distinct_texts), ("near_dedup", distinct_classes), ("mixing", mixed), ("encoding", encoded)]

#: SQL can express neither the classifier nor the classes nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        spark.sparkContext.setJobDescription(f"pipeline: {name}")
        docs = checkpointed(stage(spark, docs, sf_dir))
    spark.sparkContext.setJobDescription(None)
    return STAGES[-1][1](spark, docs, sf_dir)
