"""The corpus operators' queries and their SQL, and the pipeline."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage with ``query(spark, sf_dir)`` and perhaps ``SQL``.
MODULES = {
    "op1_licenses": "licenses",
    "op2_language": "langid",
    "op3_flac": "flac",
    "op4_toxicity": "toxicity",
    "op5_jaccard": "jaccard",
    "op6_packing": "packing",
    "op7_wrappers": "wrappers",
    "op8_decontamination": "decontam",
    "op9_warc": "warc",
    "op10_secrets": "secrets",
    "op11_urls": "urls",
    "op12_turns": "turns",
    "op13_whitening": "whitening",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {name: _module(m).query for name, m in MODULES.items()}


def oracle_sql() -> dict:
    return {name: _module(m).SQL for name, m in MODULES.items() if getattr(_module(m), "SQL", None)}
