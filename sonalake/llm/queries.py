"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_dedup, license_scan, lm, mixing, near_dedup, pii, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": ann.op1_ann,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_url_filters": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
}
