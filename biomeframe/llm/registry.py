"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_chat_formatting
from .decontam import op3_benchmark_decontamination
from .html_text import op10_html_extraction
from .jaccard import op9_jaccard_join
from .langid import op2_language_id
from .lines import OP7_SQL, op7_line_dedup
from .oracles import OP3_SQL, OP8_SQL, OP9_SQL
from .packing import op4_best_fit_packing
from .quality import op6_quality_rules
from .suffix import op8_substring_dedup
from .urls import OP5_SQL, op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
}
