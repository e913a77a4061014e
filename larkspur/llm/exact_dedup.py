"""Exact deduplication by content-defined chunk recipes, DataFrame functions only.

A text is lower-cased (A-Z only) and cut into chunks at content-defined places: the first
sentence or line end after ``MIN_CHUNK`` characters, or ``MAX_CHUNK`` characters where none
comes. Each chunk gets an identifier of fixed size: SHA-256, a 64-bit hash of another family
and the length. A document's recipe is the ordered list of its identifiers; documents are
equal when their recipes are. Only recipes are shuffled, never the texts.

Identifiers are verified: all uses of one SHA-256 must agree on the second hash and the
length, else the run fails instead of merging different texts.

Defined results. Null text counts as empty; all empty texts are equal. A null id takes part
in its group and stays only when no id in the group is set. Rows that repeat an id and a text
are the same document and get the same values. An empty table gives an empty result. Columns
other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, ids_without_kept, without

MIN_CHUNK = 1024
MAX_CHUNK = 8192
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z to a-z, all else as it is; lower() is the same thing for texts of ASCII only."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def chunks(norm: Column) -> Column:
    """The text's content-defined chunks in order; joined they are the text."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.unhex(F.sha2(chunk, 256)).alias("sha"), F.xxhash64(chunk).alias("check"), F.char_length(chunk).alias("n"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text_sha256 and the ordered identifiers of its chunks."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), identifier).alias("recipe"))


def chunk_store(found: DataFrame) -> DataFrame:
    """One row per distinct chunk: sha, uses, and whether all its uses agree."""
    use = found.select(F.explode("recipe").alias("c")).select("c.*")
    return use.groupBy("sha").agg(
        F.count("*").alias("uses"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1")
    ).select("sha", "uses", F.col("n0").alias("n_chars"), ((F.col("c0") == F.col("c1")) & (F.col("n0") == F.col("n1"))).alias("verified"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    found = checkpointed(recipes(docs, id_col, text_col))
    bad = chunk_store(found).where(~F.col("verified")).limit(1).count()
    if bad:
        raise ValueError("two different chunks share a SHA-256")
    key = F.sha2(F.array_join(F.transform("recipe", lambda c: F.hex(c["sha"])), ","), 256)
    found = found.select("doc_id", "text_sha256", F.col("recipe.sha").alias("recipe"), F.size("recipe").cast("long").alias("n_chunks"), key.alias("recipe_key"))
    # The ordered lists themselves are the grouping key; the digest only names a group afterwards.
    groups = found.groupBy("recipe", "recipe_key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # Written out so that both sides of the join are plain exchanges and a hot group can be split.
    groups = checkpointed(groups.select("recipe_key", "keep_id", "group_size"))
    return found.join(groups, "recipe_key", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, in their own columns. A row without an id cannot be named and stays; an id goes only if none of its rows is kept."""
    return without(docs, ids_without_kept(exact_dedup(docs, id_col, text_col)), id_col)


QUERY = "op8_exact_dedup"

ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""


def op8_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
