"""The queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (chat, collocations, decontam, hard_negatives, html_tree, licences, mixing,
                            order_minhash, personal, sharding, simhash, tokens, toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_weighted_hash_tree": sharding.op1_weighted_hash_tree,
        "op2_soft_membership_mix": mixing.op2_soft_membership_mix,
        "op3_order_minhash": order_minhash.op3_order_minhash,
        "op4_simple8b_tokens": tokens.op4_simple8b_tokens,
        "op5_dom_sum_product": html_tree.op5_dom_sum_product,
        "op6_role_repair": chat.op6_role_repair,
        "op7_license_digests": licences.op7_license_digests,
        "op8_toxicity_ftrl": toxicity.op8_toxicity_ftrl,
        "op9_simhash_blocks": simhash.op9_simhash_blocks,
        "op10_positional_index": decontam.op10_positional_index,
        "op11_suffix_collocations": collocations.op11_suffix_collocations,
        "op12_angular_negatives": hard_negatives.op12_angular_negatives,
        "op13_weak_supervision_pii": personal.op13_weak_supervision_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_license_digests": licences.oracle(),
        "op11_suffix_collocations": collocations.oracle(),
        "op12_angular_negatives": hard_negatives.oracle(),
    }
