"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: the module that has a function of that name, and SQL for it, if any, in ORACLE_SQL.
QUERIES = {
    "op1_token_files": "token_files",
    "op2_html_text": "html_text",
    "op3_toxicity": "toxicity",
    "op4_minmax_dedup": "minmax_dedup",
    "op5_url_filter": "url_filter",
    "op6_decontaminate": "decontaminate",
    "op7_ann": "ann",
    "op8_substring_dedup": "substring_dedup",
    "op9_bpe": "bpe",
    "op10_wordpiece_counts": "wordpiece",
    "op11_conversation_repair": "conversation_repair",
    "op12_hard_negatives": "hard_negatives",
    "op13_chat_format": "chat_format",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__name__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in dict.fromkeys(QUERIES.values()):
        found |= getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", {})
    return found
