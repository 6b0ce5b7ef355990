"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import byte_bpe, centroids, divergence_audit, edit_fingerprint, html_extract, mixing, pii, quality_classifier, quality_rules, simhash, token_counts, token_files, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_pii": pii.query,
    "op3_mixing": mixing.query,
    "op4_url_filter": url_filter.query,
    "op5_simhash": simhash.query,
    "op6_html_extract": html_extract.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_edit_fingerprint": edit_fingerprint.query,
    "op11_centroids": centroids.query,
    "op12_token_files": token_files.query,
    "op13_divergence_audit": divergence_audit.query,
}

#: Left out where SQL cannot express the operator; tests hold those against brute force.
ORACLES = {
    "op1_quality_rules": quality_rules.oracle(),
    "op3_mixing": mixing.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op11_centroids": centroids.oracle(),
    "op13_divergence_audit": divergence_audit.oracle(),
}
