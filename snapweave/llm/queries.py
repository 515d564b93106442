"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, mixing, near, pii, quality, secrets, substring, suffix, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": tokens.op1_token_output,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_mix": mixing.op3_mix,
    "op4_licenses": licenses.op4_licenses,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_near_dedup": near.op8_near_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_decontaminate": decontam.op10_decontaminate,
}
