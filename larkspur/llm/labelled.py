"""Bounded samples of documents to fit classifiers on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, fold

PLACES = 1 << 30


def bounded(rows: DataFrame, bound: int, salt: int) -> DataFrame:
    """All rows, or about ``bound`` of them and never more, by a threshold on a hash of ``__id``.

    The threshold comes from their count, a little low, so that nothing is sorted and each partition
    sends on its share alone. The result has a fixed bound and may be broadcast.
    """
    rows = checkpointed(rows)
    n = rows.count()
    if n > bound:
        share = max(1.0, bound - 4 * math.sqrt(bound)) / n
        rows = rows.where(F.pmod(F.xxhash64("__id", F.lit(salt)), F.lit(PLACES)) < F.lit(math.ceil(share * PLACES)))
    return rows.limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled documents outside fold 0, picked by a hash of the id.

    The picked ids have a fixed bound, so they are broadcast; the texts stay where they are.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded(rows, bound, 0)), F.col("doc_id") == F.col("__id")).select("doc_id", "text", F.col("__label").alias("label"))


def unlabelled_sample(docs: DataFrame, bound: int) -> DataFrame:
    """Texts of at most ``bound`` documents outside fold 0, picked by a hash of the id."""
    rows = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).select(F.col("doc_id").alias("__id"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded(rows, bound, 7)), F.col("doc_id") == F.col("__id")).select("doc_id", "text")
