"""Registered queries of this subpackage, one for each operator, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from . import chat_format, decontamination, edit_counts, exact_dedup, license_scan, ngram_join, quality, sentencepiece_codec, suffix_dedup, token_files

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_license_scan": license_scan.query,
    "op3_quality": quality.query,
    "op4_edit_counts": edit_counts.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_ngram_join": ngram_join.query,
    "op8_chat_format": chat_format.query,
    "op9_decontamination": decontamination.query,
    "op10_token_files": token_files.query,
}

ORACLE_SQL = {
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
}
