"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, gru, jaccard_join, licenses, lm_scoring, merkle, packing, pii, quality_model, quality_rules, runs, simhash, token_ids  # noqa: F401


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_pii": pii.op2_pii,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_token_ids": token_ids.op4_token_ids,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_quality": quality_model.op6_quality,
        "op7_chat": chat.op7_chat,
        "op8_simhash": simhash.op8_simhash,
        "op9_packing": packing.op9_packing,
        "op10_licenses": licenses.op10_licenses,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_runs": runs.op12_runs,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.sql(), "op3_decontaminate": decontaminate.SQL, "op7_chat": chat.SQL, "op10_licenses": licenses.sql(), "op11_jaccard_join": jaccard_join.SQL, "op13_merkle": merkle.sql()}
