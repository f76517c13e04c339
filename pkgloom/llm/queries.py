"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import pipeline

#: Query name: module.
_QUERIES = {
    "op4_quality": "op04_quality",
    "op5_exact_dedup": "op05_exact_dedup",
    "op1_chat": "op01_chat",
    "op2_suffix_dedup": "op02_suffix_dedup",
    "op3_ngram_join": "op03_ngram_join",
    "op6_mixing": "op06_mixing",
    "op7_licenses": "op07_licenses",
    "op8_pii": "op08_pii",
    "op9_decontamination": "op09_decontamination",
    "op10_language_id": "op10_language_id",
    "op11_alignment": "op11_alignment",
    "op12_warc": "op12_warc",
    "op13_repair": "op13_repair",
}
_SQL = ("op1_chat", "op5_exact_dedup", "op9_decontamination", "op12_warc", "op13_repair")


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{_QUERIES[name]}").ORACLE for name in _SQL}
