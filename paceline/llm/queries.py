"""Queries of this subpackage, and check SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceline.llm.binary_records import op6_binary_records
from paceline.llm.decontamination import op5_benchmark_decontamination
from paceline.llm.fill_in_middle import CHECK_OP13, op13_fill_in_middle
from paceline.llm.hard_negatives import CHECK_OP11, op11_hard_negatives
from paceline.llm.language_id import op4_language_id
from paceline.llm.language_model import op8_lm_scoring
from paceline.llm.odd_sketch import op12_minhash_near_dedup
from paceline.llm.packing import op1_best_fit_packing
from paceline.llm.prefix_hashes import op9_prefix_fingerprints
from paceline.llm.secret_scan import op7_secret_scan
from paceline.llm.simhash import op2_simhash_near_dedup
from paceline.llm.url_filter import op10_url_filter
from paceline.llm.warc import CHECK_OP3, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_simhash_near_dedup,
        op3_warc,
        op4_language_id,
        op5_benchmark_decontamination,
        op6_binary_records,
        op7_secret_scan,
        op8_lm_scoring,
        op9_prefix_fingerprints,
        op10_url_filter,
        op11_hard_negatives,
        op12_minhash_near_dedup,
        op13_fill_in_middle,
    )
}
CHECKS: dict[str, str] = {"op3_warc": CHECK_OP3, "op11_hard_negatives": CHECK_OP11, "op13_fill_in_middle": CHECK_OP13}
