"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_text, merkle, near_dedup, pii, quality, sharding, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_minhash": near_dedup.op9_minhash,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_pii": pii.op13_pii,
}

SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL, "op7_url_filter": url_filter.OP7_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
