"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, jaccard_join, kd_sharding, mixing, packing, quality, secrets, suffix_dedup, toxicity, weighted_sampling
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*[read_table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": _over(secrets.op1, "documents"),
        "op2_ngram_jaccard_join": _over(jaccard_join.op2, "documents"),
        "op3_mixture_packing": _over(packing.op3, "documents"),
        "op4_toxicity_chains": _over(toxicity.op4, "documents", "labels"),
        "op5_distribution_divergence": _over(quality.op5, "documents"),
        "op6_hash_threshold_mixing": _over(mixing.op6, "documents"),
        "op7_kd_tree_sharding": _over(kd_sharding.op7, "documents"),
        "op8_chat_format": _over(chat_format.op8, "conversations"),
        "op9_weighted_sampling": _over(weighted_sampling.op9, "documents"),
        "op10_suffix_dedup": _over(suffix_dedup.op10, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_hash_threshold_mixing": mixing.ORACLE, "op8_chat_format": chat_format.ORACLE}
