"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, exact_dedup, hard_negatives, jaccard_join, packing, pii, prefix_trie, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op4_url_filter": url_filter.op4_url_filter,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_pii": pii.op8_pii,
        "op9_packing": packing.op9_packing,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_jaccard_join": jaccard_join.op12_jaccard_join,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.OP4_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_jaccard_join": jaccard_join.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
