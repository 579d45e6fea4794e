"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, decontam, jaccard_join, pii, quality, secrets, token_counts, token_store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_pii": pii.op6_pii,
    "op7_quality": quality.op7_quality,
    "op8_token_store": token_store.op8_token_store,
    "op9_secrets": secrets.op9_secrets,
    "op10_neighbours": ann.op10_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_decontamination": decontam.ORACLE_SQL,
}
