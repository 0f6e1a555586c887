"""Queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

#: query: (module, function)
_WHERE = {
    "op1_suffix_dedup": "substrings",
    "op2_simhash": "simhash",
    "op3_secrets": "secrets",
    "op4_mixing": "mixing",
    "op5_sharding": "sharding",
    "op6_warc": "warc",
    "op7_substrings": "fingerprintlog",
    "op8_decontamination": "decontamination",
    "op9_quality": "quality",
    "op10_lm_score": "lmscore",
    "op11_jaccard_join": "jaccardjoin",
    "op12_filter_audit": "filteraudit",
    "op13_alignment": "alignment",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"corpusmill.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from corpusmill.llm import oracles
    from corpusmill.llm.filteraudit import ORACLE as audit
    from corpusmill.llm.jaccardjoin import ORACLE as jaccard
    from corpusmill.llm.quality import ORACLE as quality

    return {"op1_suffix_dedup": oracles.SUFFIXES, "op3_secrets": oracles.SECRETS, "op6_warc": oracles.WARC, "op7_substrings": oracles.SUBSTRINGS, "op8_decontamination": oracles.DECONTAMINATION, "op9_quality": quality, "op11_jaccard_join": jaccard, "op12_filter_audit": audit}
