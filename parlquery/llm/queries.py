"""Queries of this subpackage for the registry."""

from __future__ import annotations

from . import bpe, mixing, nn_descent, pii_skipchain, quality, secret_lexing, simhash, token_counts, toxicity, training_order

QUERIES = {
    "op1_toxicity_chain": toxicity.query,
    "op2_pii_skipchain": pii_skipchain.query,
    "op3_simhash_deletion": simhash.query,
    "op4_secret_lexing": secret_lexing.query,
    "op5_nn_descent": nn_descent.query,
    "op6_mix_tree": mixing.query,
    "op7_token_counts": token_counts.query,
    "op8_bpe_tree": bpe.query,
    "op9_quality_weak": quality.query,
    "op10_training_order": training_order.query,
}

ORACLE_SQL: dict[str, str] = {}
