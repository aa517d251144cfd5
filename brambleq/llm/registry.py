"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from brambleq.llm import bpe, decontaminate, language_id, language_model, line_dedup, secrets, simhash, substring_dedup, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_line_dedup": line_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_language_model": language_model.query,
    "op6_secrets": secrets.query,
    "op7_bpe": bpe.query,
    "op8_simhash": simhash.query,
    "op9_language_id": language_id.query,
    "op10_topk": topk.query,
}
SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op10_topk": topk.SQL,
}
