"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_mixing": "mixing",
    "op2_url_filter": "urls",
    "op3_quality_rules": "outliers",
    "op4_chat_format": "chat",
    "op5_lm_score": "lm",
    "op6_fingerprints": "iblt",
    "op6_nearest_versions": "versions",
    "op7_packing": "packing",
    "op8_sharding": "sharding",
    "op9_quality_classifier": "classifier",
    "op10_ngram_join": "setjoin",
}


def queries() -> dict:
    return {name: lambda spark, sf_dir, m=m: import_module(f"graphloom.llm.{m}").query(spark, sf_dir) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"graphloom.llm.{m}"), "SQL", None) for name, m in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
