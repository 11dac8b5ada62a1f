"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from impactspark.llm import decontamination, html_text, mixing, neardup, pii, quality_classifier, quality_rules, sharding, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_kd_shards": sharding.op3_kd_shards,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_pii": pii.op5_pii,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_mix": mixing.op7_mix,
    "op8_html_text": html_text.op8_html_text,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": neardup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_kd_shards": sharding.OP3_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op5_pii": pii.OP5_SQL,
    "op7_mix": mixing.OP7_SQL,
}
