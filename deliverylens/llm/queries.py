"""The dealt queries (name -> callable(spark, sf_dir)) and the SQL of those that SQL can express."""

from __future__ import annotations

from deliverylens.llm import decontamination, exact_dedup, hard_negatives, language_id, language_model, license_scan, line_dedup, ngram_join, sentencepieces, spelling_variants, token_counts, token_files, toxicity

QUERIES = {
    "op1_lm_scoring": language_model.op1_lm_scoring,
    "op2_token_files": token_files.op2_token_files,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_language_id": language_id.op10_language_id,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {**exact_dedup.SQL, **hard_negatives.SQL}
