"""The queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from larkspur.llm import exact_dedup, lm, mixing, near_dedup, pieces, quality, tiff, token_counts, toxicity, warc


def queries():
    import corpus_pipeline

    return {
        pieces.QUERY: pieces.op1_sentencepiece,
        toxicity.QUERY: toxicity.op2_toxicity,
        lm.QUERY: lm.op3_lm_scores,
        mixing.QUERY: mixing.op4_mix_sources,
        near_dedup.QUERY: near_dedup.op5_near_dedup,
        warc.QUERY: warc.op6_warc_revisits,
        token_counts.QUERY: token_counts.op7_token_counts,
        exact_dedup.QUERY: exact_dedup.op8_exact_dedup,
        tiff.QUERY: tiff.op9_tiff_pages,
        quality.QUERY: quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {mixing.QUERY: mixing.ORACLE, warc.QUERY: warc.ORACLE, exact_dedup.QUERY: exact_dedup.ORACLE}
