"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, embedding_dedup, html_extraction, importance, jaccard_join, manifest, mixing, packing, pii, quality_classifier, quality_rules, secrets, tokens

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_token_counts": tokens.op5_token_counts,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_packing": packing.op8_packing,
    "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_pii": pii.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op7_secret_scans": secrets.OP7_SQL,
    "op9_ngram_jaccard_join": jaccard_join.OP9_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
