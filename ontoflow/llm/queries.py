"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontamination, html_text, language, neardup, packing, token_files, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_html_text": html_text.op2_html_text,
        "op3_nearest": ann.op3_nearest,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_packing": packing.op6_packing,
        "op8_token_files": token_files.op8_token_files,
        "op7_warc": warc.op7_warc,
        "op9_language": language.op9_language,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE_SQL,
        "op4_decontamination": decontamination.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
    }
