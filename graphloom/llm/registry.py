"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import decontaminate, licenses, lm_score, mixing, neardup, quality, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_warc": warc.op8_warc,
    "op9_licenses": licenses.op9_licenses,
    "op10_neardup": neardup.op10_neardup,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_licenses": licenses.licenses_sql(),
    "op10_neardup": neardup.OP10_SQL,
}
