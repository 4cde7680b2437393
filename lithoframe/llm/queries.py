"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, divergence, html, merkle, mixing, neardup, quality, sharding, suffixes, tokens, toxicity, urls, warc

QUERIES = {
    "op1_url_filters": urls.query,
    "op2_decontamination": decontaminate.query,
    "op3_suffix_dedup": suffixes.query,
    "op4_toxicity": toxicity.query,
    "op5_warc": warc.query,
    "op6_mixing": mixing.query,
    "op7_quality_rules": quality.query,
    "op8_sharding": sharding.query,
    "op9_html_text": html.query,
    "op10_near_duplicates": neardup.query,
    "op11_token_ids": tokens.query,
    "op12_merkle_manifest": merkle.query,
    "op13_source_divergence": divergence.query,
}
ORACLES = {
    "op1_url_filters": urls.SQL,
    "op5_warc": warc.SQL,
    "op6_mixing": mixing.SQL,
    "op7_quality_rules": quality.SQL,
    "op10_near_duplicates": neardup.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_source_divergence": divergence.SQL,
}
