"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphward.llm import decontamination, lm_scoring, mixing, pii, secrets, sharding, simhash, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sharding.op1_reshard_min_cost_flow,
        toxicity.op2_toxicity_nnpu,
        lm_scoring.op3_cross_entropy_difference,
        topk.op4_top_k_norm_sorted,
        url_filter.op5_url_bloom_join,
        pii.op6_pii_bootstrapped,
        mixing.op7_mix_systematic,
        simhash.op8_simhash_covering_lsh,
        secrets.op9_secrets_ownership,
        decontamination.op10_decontaminate_bm25_wand,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_top_k_norm_sorted": topk.SQL, "op5_url_bloom_join": url_filter.SQL, "op7_mix_systematic": mixing.SQL}
