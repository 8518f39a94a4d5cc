"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from docloom.llm import decontamination, html_extract, license_scan, near_dedup, packing, quality_rules, secret_scan, substring_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_packing": packing.op9_packing,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE_SQL,
        "op3_secret_scan": secret_scan.ORACLE_SQL,
        "op4_near_dedup": near_dedup.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
        "op8_license_scan": license_scan.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
    }
