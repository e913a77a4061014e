"""Mixing sources to target weights by iterative proportional fitting, DataFrame functions only.

Documents fall into cells by their dimensions (source, language and topic by default). A cell's
weight starts as its tokens and is raked to each dimension's target marginal in turn, ``SWEEPS``
times over. No cell can give more than all its tokens: its weight stops there within each step, and
the next ones raise the other cells of its values instead, so that the marginals are met where
the corpus can meet them (``reached`` tells how near). Every document then stays with its cell's
calibrated probability ``budget * share of the raked weight / share of the tokens``, decided by a
hash of its id alone, so a rerun or a lost executor changes nothing.

The raking runs over one row per cell, so its size is that of the dimensions' product as it
occurs, whatever the number of documents. Up to ``BROADCAST_CELLS`` cells are summed by windows;
beyond it by partial sums that the cells then meet in a join, so that no task holds all cells of a value. Documents meet their cell's rate by a broadcast only
while the cells are few (``BROADCAST_CELLS``), by a shuffled join beyond it.

Defined results. A null dimension is a value of its own, written ''. Null texts are empty.
Empty documents weigh 0 tokens and share their cell's probability; a cell without any tokens
keeps all its documents. A null id is decided as the empty text would be by ``mix``; ``sample_mix``
keeps its row, which no id can name. Rows that share an id go or stay together. Targets that name no
present value are ignored and the rest are rescaled. Repeated rows are decided alike. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import Tables, checkpointed, table, without

DIMS = ("source", "lang", "topic")
SWEEPS = 12
#: Sweeps in one plan; the cells are written out between plans, so that no plan grows too deep.
PLAN_SWEEPS = 6
#: Exponents that temper each marginal's natural shares when no targets are given.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
BUDGET = 0.6
BROADCAST_CELLS = 20_000
#: The topics, first match wins, as literal needles.
TOPICS = (("legal", ("All rights reserved", "Licensed under", "Copyright")), ("contact", ("@",)), ("web", ("http://", "https://")), ("table", (" | ",)))


def topic(text: Column) -> Column:
    """A coarse topic from fixed marks in the whole text; 'prose' where none occurs."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit("prose")
    for name, needles in reversed(TOPICS):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles]), name).otherwise(out)
    return out


def token_weight(text: Column) -> Column:
    """Tokens of a text: maximal runs without a space, tab or line end."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("long")


def rake(cells: DataFrame, dims=DIMS, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """Add raked (shares; 1 in all where the targets can be met), most (a cell's share at most) and per-dimension target shares to cells of (dims, tokens)."""
    names = list(cells.columns)
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    tables = Tables(cells.sparkSession)
    total = cells.agg(F.sum(F.col("tokens").cast("double"))).first()[0] or 1.0

    def summed(frame: DataFrame, d: str) -> DataFrame:
        """Add __sum, what raked comes to for the row's value of d."""
        if few:
            return frame.withColumn("__sum", F.sum("raked").over(W.partitionBy(d)))
        frame = tables.write(frame)
        sums = tables.write(frame.groupBy(d).agg(F.sum("raked").alias("__sum")))
        return frame.join(sums, d)

    share = F.col("tokens").cast("double") / F.lit(total)
    out = cells.withColumn("raked", share).withColumn("most", share / F.lit(float(budget)))
    spread = {}
    for d in dims:
        out = summed(out, d)
        if targets and d in targets:
            given = F.create_map([F.lit(x) for k, v in targets[d].items() for x in (k, float(v))])
            want = F.coalesce(F.try_element_at(given, F.col(d)), F.lit(0.0))
        else:
            want = F.pow("__sum", F.lit(TEMPER.get(d, 1.0)))
        some = F.col("__sum") > 0
        out = out.withColumn(f"target_{d}", F.when(some, want).otherwise(0.0))
        # A value's target is spread over its cells, so that the sum over cells is the sum over values.
        out = out.withColumn(f"__spread_{d}", F.col(f"target_{d}") * F.when(some, F.col("raked") / F.col("__sum")).otherwise(0.0)).drop("__sum")
        spread[d] = F.sum(f"__spread_{d}").alias(d)
    # Sums over everything are single numbers; nothing is gathered in one task for them.
    out = checkpointed(out)
    sums = out.agg(*spread.values()).first()
    for d in dims:
        out = out.withColumn(f"target_{d}", F.try_divide(F.col(f"target_{d}"), F.lit(sums[d] or 0.0)))
    out = out.select(*names, "raked", "most", *[f"target_{d}" for d in dims])
    for k in range(sweeps):
        if few and k and k % PLAN_SWEEPS == 0:
            out = checkpointed(out)
        for d in dims:
            step = F.coalesce(F.try_divide(F.col("raked") * F.col(f"target_{d}"), F.col("__sum")), F.lit(0.0))
            out = summed(out, d).withColumn("raked", F.least(step, F.col("most"))).drop("__sum")
        tables.drop(but_last=2)
    out = checkpointed(out.select(*names, "raked", "most", *[f"target_{d}" for d in dims]))
    tables.drop()
    return out


def reached(raked: DataFrame, dims=DIMS) -> DataFrame:
    """dim, value, target and reached: the shares of the kept tokens as they should be and as the rates make them."""
    parts = [raked.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), F.sum("raked").alias("reached")) for d in dims]
    return reduce(lambda a, b: a.unionByName(b), parts)


def uniform(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, dims=DIMS, targets=None, budget: float = BUDGET, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", values: dict[str, Column] | None = None) -> DataFrame:
    """A row per document: doc_id, the dims, n_tokens, probability and kept."""
    values = {"topic": topic(F.col(text_col))} | (values or {})
    seen = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.coalesce(values.get(d, F.col(d) if d in docs.columns else F.lit("")).cast("string"), F.lit("")).alias(d) for d in dims],
        token_weight(F.col(text_col)).alias("n_tokens"),
    )
    seen = checkpointed(seen)
    cells = checkpointed(seen.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, dims, targets, sweeps, budget)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(total)
    rates = raked.select(*dims, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(budget)) * F.try_divide(F.col("raked"), share))).otherwise(1.0).alias("probability"))
    rates = checkpointed(rates)
    if rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    out = seen.join(rates, list(dims), "left")
    return out.select("doc_id", *dims, "n_tokens", F.round("probability", 9).alias("probability"), (uniform(F.col("doc_id")) < F.round("probability", 9)).alias("kept"))


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, in their own columns."""
    gone = mix(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return without(docs, gone, options.get("id_col", "doc_id"))


QUERY = "op4_mix_sources"


def _oracle() -> str:
    case = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in TOPICS) + " ELSE 'prose' END"
    sql = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {case} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n_tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        f"r0 AS (SELECT *, tokens / sum(tokens) OVER () AS raked, tokens / sum(tokens) OVER () / {BUDGET} AS most FROM c)",
        "w AS (SELECT *, " + ", ".join(f"sum(raked) OVER (PARTITION BY {d}) AS share_{d}" for d in DIMS) + " FROM r0)",
        "g AS (SELECT *, " + ", ".join(f"CASE WHEN share_{d} > 0 THEN pow(share_{d}, {TEMPER[d]}) ELSE 0.0 END AS want_{d}" for d in DIMS) + " FROM w)",
        "t AS (SELECT source, lang, topic, tokens, raked, most, " + ", ".join(f"want_{d} / sum(CASE WHEN share_{d} > 0 THEN want_{d} * raked / share_{d} ELSE 0.0 END) OVER () AS target_{d}" for d in DIMS) + " FROM g)",
    ]
    last = "t"
    for k in range(SWEEPS):
        for d in DIMS:
            sql.append(f"s{k}_{d} AS (SELECT * REPLACE (least(coalesce(raked * target_{d} / nullif(sum(raked) OVER (PARTITION BY {d}), 0), 0.0), most) AS raked) FROM {last})")
            last = f"s{k}_{d}"
    sql.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(least(1.0, {BUDGET} * raked / (tokens / sum(tokens) OVER ())), 9) ELSE 1.0 END AS probability FROM {last})".replace("sum(tokens) OVER ()", f"(SELECT sum(tokens) FROM {last})"))
    return (
        "WITH " + ",\n".join(sql) + "\nSELECT doc_id, source, lang, topic, n_tokens, probability,"
        " ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS kept FROM d JOIN p USING (source, lang, topic)"
    )


ORACLE = _oracle()


def op4_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
