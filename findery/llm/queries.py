"""The registered queries of these operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that has ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_language_id": "language_id",
    "op3_lm_scoring": "lm_scoring",
    "op4_decontamination": "decontamination",
    "op5_byte_bpe": "byte_bpe",
    "op6_license_scan": "license_scan",
    "op7_toxicity": "toxicity",
    "op8_ann": "ann",
    "op9_ngram_jaccard": "ngram_jaccard",
    "op10_html_extract": "html_extract",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: _module(name).query for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
