"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellspan.llm import decontaminate, jaccard_join, language_id, licence_scan, line_dedup, quality_rules, site_quality, suffix_dedup, token_mix, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_mix": token_mix.op4_token_mix,
    "op5_licence_scan": licence_scan.op5_licence_scan,
    "op6_site_quality": site_quality.op6_site_quality,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_language_id": language_id.op8_language_id,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op9_url_rules": url_rules.ORACLE,
}
