"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op10_simhash",
    "op9_mixing",
    "op5_sharding",
    "op8_bpe",
    "op3_html",
    "op1_ann",
    "op6_pseudonyms",
    "op7_kneser_ney",
    "op2_outliers",
    "op4_katz",
    "op11_divergence",
    "op12_ngram_join",
    "op13_conversations",
)
_found = [import_module(f"tributary.llm.registry.{m}") for m in MODULES]
QUERIES = {m.NAME: m.query for m in _found}
ORACLES = {m.NAME: m.SQL for m in _found if m.SQL}
