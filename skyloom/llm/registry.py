"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, mixing, ngram_join, pseudonyms, quality_classifier, quality_rules, secret_scan, token_output

QUERIES = {
    "op1_html_extraction": html_extract.query,
    "op2_source_mixing": mixing.query,
    "op3_decontamination": decontaminate.query,
    "op4_secret_scan": secret_scan.query,
    "op5_chat_format": chat_format.query,
    "op6_pii_pseudonyms": pseudonyms.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_token_output": token_output.query,
    "op10_ngram_join": ngram_join.query,
}

ORACLE_SQL = {
    "op2_source_mixing": mixing.ORACLE_SQL,
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op4_secret_scan": secret_scan.ORACLE_SQL,
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
}
