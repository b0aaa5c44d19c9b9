"""Queries of this subpackage: opN_<name> over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: N: (module, query)
_OPS = {
    1: ("substrings", "op1_suffix_array_dedup"),
    2: ("chat", "op2_chat_formatting"),
    3: ("neardup", "op3_minhash_near_dedup"),
    4: ("ann", "op4_permutation_index"),
    5: ("mixing", "op5_mixing"),
    6: ("packing", "op6_best_fit_packing"),
    7: ("vectordedup", "op7_embedding_near_dedup"),
    8: ("secrets", "op8_secret_scans"),
    9: ("lmscore", "op9_masked_pseudo_likelihood"),
    10: ("langid", "op10_language_id"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name in _OPS.values()}


def oracle_sql() -> dict[str, str]:
    from . import chat, oracles, secrets

    return {
        "op1_suffix_array_dedup": oracles.OP1,
        "op2_chat_formatting": chat.ORACLE,
        "op3_minhash_near_dedup": oracles.OP3,
        "op5_mixing": oracles.op5(),
        "op7_embedding_near_dedup": oracles.OP7,
        "op8_secret_scans": secrets.oracle_op8(),
    }
