"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: the module of this subpackage that has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op9_html_extraction": "html_extraction",
    "op8_license_scan": "license_scan",
    "op5_quality_classifier": "quality_classifier",
    "op2_sentencepiece": "sentencepieces",
    "op6_language_id": "language_id",
    "op7_toxicity": "toxicity",
    "op3_quality_rules": "quality_rules",
    "op4_suffix_array_dedup": "suffix_dedup",
    "op1_benchmark_decontamination": "decontaminate",
    "op10_simhash": "simhash",
    "op11_token_alignment": "token_alignment",
    "op12_phrase_dedup": "phrase_dedup",
    "op13_conversation_repair": "conversation_repair",
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
