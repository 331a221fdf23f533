"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, contracts, exact_dedup, langid, packing, pii, secrets, sharding, simhash, token_counts, topk

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: list[Query] = [
        pii.op1_weak_supervision_pii,
        langid.op2_rank_order_languages,
        sharding.op3_feistel_shards,
        topk.op4_exact_top_k,
        exact_dedup.op5_golomb_exact_dedup,
        packing.op6_best_fit_packing,
        simhash.op7_simhash_components,
        secrets.op8_crf_secrets,
        bpe.op9_bpe_round_trip,
        token_counts.op10_pre_token_counts,
    ]
    return {f.__name__: f for f in found} | contracts.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": topk.ORACLE, "op5_golomb_exact_dedup": exact_dedup.ORACLE} | contracts.SQL
