"""Queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from sondage.llm import best_fit, decontaminate, html_extract, language_id, line_dedup, ngram_join, quality_rules, substring_dedup, token_counts, token_output

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_best_fit_packing": best_fit.op3_best_fit_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLES: dict[str, str] = {"op7_line_dedup": line_dedup.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
