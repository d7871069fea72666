"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12
from .bestfit import op13
from .chunks import op9
from .common import ship_repo
from .mincut import op2
from .mixing import OP10_SQL, op10
from .packing import op7
from .pii import op4
from .quality import op1
from .rollup import OP8_SQL, op8
from .simhash import op6
from .templates import OP3_SQL, op3
from .vectors import op5
from .whitening import op11


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_repo(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        k: _shipped(f)
        for k, f in {
            "op1_line_field_quality": op1,
            "op2_mincut_main_text": op2,
            "op3_template_line_dedup": op3,
            "op4_disclosure_pii": op4,
            "op5_small_world_vectors": op5,
            "op6_simhash_near_dedup": op6,
            "op7_packing": op7,
            "op8_delta_rollup": op8,
            "op9_gear_substring_dedup": op9,
            "op10_poisson_mixing": op10,
            "op11_whitening": op11,
            "op12_segment_alignment": op12,
            "op13_best_fit_packing": op13,
        }.items()
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_template_line_dedup": OP3_SQL,
        "op8_delta_rollup": OP8_SQL,
        "op10_poisson_mixing": OP10_SQL,
    }
