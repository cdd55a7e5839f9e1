"""The contract queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import op5_chat_formatting
from .decontamination import op2_benchmark_decontamination
from .bpe import op6_bpe
from .license_scan import op10_license_scan
from .line_dedup import op3_line_dedup
from .quality_classifier import op9_quality_classifier
from .secret_scan import op7_secret_scan
from .simhash import op4_simhash_near_dedup
from .sql import ORACLE_SQL
from .substring_dedup import op1_substring_dedup
from .topk_search import op8_topk_search

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_bpe": op6_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_topk_search": op8_topk_search,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
