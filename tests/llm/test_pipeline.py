import collections

import pytest

import corpus_pipeline
from larkspur.llm import exact_dedup, near_dedup, pieces, quality, registry
from larkspur.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(set(ids)) == len(ids)
    texts = collections.Counter(r["text"].lower() for r in docs.select("text").collect())
    assert max(texts.values()) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    v = pieces.Vocabulary()
    by = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(last) == len(ids) and all(pieces.decode(v, r["token_ids"]) == by[r["doc_id"]].replace(pieces.BLANK, " ") for r in last)


def test_stages_drop_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    net = quality.train(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, net).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in corpus_pipeline.good(spark, docs, SF).select("doc_id").collect()} == good
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.distinct_texts(spark, docs, SF).select("doc_id").collect()} == kept
    kept = {r["doc_id"] for r in near_dedup.near_classes(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.distinct_classes(spark, docs, SF).select("doc_id").collect()} == kept


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    docs = table(spark, SF, "documents").limit(40)
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "x", 0), (10**9, "", "en", "x", 0), (10**9 + 1, "word " * 30000, None, "y", 1)], docs.schema)
    more = docs.unionByName(odd).withColumn("score", F.lit("a")).withColumn("class_id", F.lit(1))
    assert stage(spark, more, SF).count() > 0
    assert stage(spark, more.limit(0), SF).count() == 0


def test_registry():
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in registry.queries() if q != "pipeline"} and "pipeline" in registry.queries()
