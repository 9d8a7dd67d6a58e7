"""Registered queries of this folder and their SQL."""

from __future__ import annotations

import importlib

#: Module and function of each query; the modules register nothing themselves.
NAMES = {
    "op1_html_extract": "html_extract",
    "op2_bitslice_topk": "bitslice_topk",
    "op3_suffix_dedup": "suffix_dedup",
    "op4_secret_scan": "secret_scan",
    "op5_language_id": "language_id",
    "op6_sequence_packing": "packing",
    "op7_source_mix": "mixing",
    "op8_block_knn": "block_knn",
    "op9_minmax_dedup": "minmax_dedup",
    "op10_toxicity": "toxicity",
    "op11_periodic_runs": "periodic_runs",
    "op12_conversation_repair": "conversation_repair",
    "op13_quality_rules": "quality_rules",
}

QUERIES = {name: getattr(importlib.import_module(f"linkloom.llm.{module}"), name) for name, module in NAMES.items()}
#: SQL stands beside the query that it describes, as SQL; the others are tested against brute force.
ORACLES = {name: module.SQL for name, module in ((n, importlib.import_module(f"linkloom.llm.{m}")) for n, m in NAMES.items()) if hasattr(module, "SQL")}
