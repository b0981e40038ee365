"""The contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .additive_quant import op7_nearest
from .decontaminate import op2_decontaminate
from .html_extract import op9_html_extract
from .language_id import op5_language_id
from .near_dup import op4_near_dup
from .oracles import ORACLES
from .packing import op6_packing
from .quality import op10_quality
from .secrets import op8_secret_scan
from .substring_dedup import op1_substring_dedup
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_near_dup": op4_near_dup,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_nearest": op7_nearest,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_extract": op9_html_extract,
    "op10_quality": op10_quality,
}

__all__ = ["ORACLES", "QUERIES"]
