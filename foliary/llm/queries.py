"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from foliary.llm import decontaminate, line_dedup, near_dedup, nearest, pieces, quality, substring_dedup, suffix_dedup, toxicity, url_filter


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_pieces": pieces.op4_pieces,
        "op5_quality": quality.op5_quality,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_nearest": nearest.op10_nearest,
    }


def oracle_sql():
    return {"op6_line_dedup": line_dedup.ORACLE}
