"""The registered queries of this folder, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

NAMES = {
    "op1_secrets": "secrets", "op2_language_id": "language", "op3_exact_topk": "topk", "op4_warc": "warc",
    "op5_quality": "quality", "op6_byte_bpe": "byte_bpe", "op7_suffix_dedup": "suffixes", "op8_toxicity": "toxicity",
    "op9_decontamination": "decontaminate", "op10_ngram_jaccard": "jaccard",
    "op11_spelling_variants": "spelling", "op12_curve_neighbours": "curves",
    "op13_fill_in_middle": "infill",
}

QUERIES, SQL = {}, {}
for _query, _name in NAMES.items():
    _module = importlib.import_module(f"logrill.llm.q_{_name}")
    QUERIES[_query] = _module.query
    if _module.SQL:
        SQL[_query] = _module.SQL
