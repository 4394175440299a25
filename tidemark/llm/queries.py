"""The corpus operators' queries, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, line_dedup, media, mixing, near_dedup, packing, pii, quality, secrets, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_quality_rules": quality.query,
    "op3_media_columns": media.query,
    "op4_language_id": language.query,
    "op5_pii_spans": pii.query,
    "op6_secret_scans": secrets.query,
    "op7_near_dedup": near_dedup.query,
    "op8_line_dedup": line_dedup.query,
    "op9_token_files": token_files.query,
    "op10_source_mixing": mixing.query,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": quality.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_source_mixing": mixing.SQL,
}
