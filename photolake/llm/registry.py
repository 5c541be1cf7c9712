"""Queries of the training-data operators."""

from __future__ import annotations

from photolake.llm import hard_negatives, license_scan, merkle, mixture, ngram_model, nn_descent, quality_rules, simhash, suffix_match, tokens, toxicity, wrappers

QUERIES = {
    "op1_nn_descent": nn_descent.op1_nn_descent,
    "op2_token_files": tokens.op2_token_files,
    "op3_decontamination": suffix_match.op3_decontamination,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ngram_model": ngram_model.op7_ngram_model,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixture": mixture.op10_mixture,
    "op11_merkle": merkle.op11_merkle,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_main_text": wrappers.op13_main_text,
}

ORACLES = {"op4_license_scan": license_scan.ORACLE_SQL, "op3_decontamination": suffix_match.ORACLE_SQL, "op10_mixture": mixture.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_main_text": wrappers.ORACLE_SQL}
