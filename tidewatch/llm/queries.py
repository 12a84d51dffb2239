"""The registered corpus queries and their DuckDB oracles."""

from __future__ import annotations

from tidewatch.llm import bpe, decontaminate, html_text, jaccard_join, lm_score, near_vectors, pipeline, quality, secrets, substring_dedup, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_jaccard": jaccard_join.op2_jaccard,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_html_text": html_text.op5_html_text,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_secrets": secrets.op7_secrets,
    "op8_near_vectors": near_vectors.op8_near_vectors,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "pipeline": pipeline.run,
}
ORACLES: dict[str, str] = {"op9_url_filter": url_filter.oracle()}
