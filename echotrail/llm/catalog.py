"""Queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from . import alignment, attribution, backtrack, html, langid, media, minhash, oracles, packing, pieces, quality, repeats, rules, whitening

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
    "op6_media_columns": media.op6_media_columns,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_token_counts": attribution.op8_token_counts,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_language_id": langid.op10_language_id,
    "op11_bpe": backtrack.op11_bpe,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}
#: DuckDB SQL for the same rows, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op5_suffix_array_dedup": oracles.REPEATS,
    "op6_media_columns": oracles.media(),
    "op7_quality_rules": oracles.quality_rules(rules.OFF_TIES),
}
