"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html_text, license_scan, line_dedup, packing, quality, simhash, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_preferences": chat.query,
    "op3_line_dedup": line_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash": simhash.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_warc": warc.query,
    "op10_html_text": html_text.query,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op2_preferences": chat.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
