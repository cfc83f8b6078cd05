"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import op3_decontamination, op9_topk, op11_codes, op13_resampling
from .op1_substring import op1_substring_dedup
from .op2_minhash import op2_minhash_near_dedup
from .op3_decontamination import op3_benchmark_decontamination
from .op4_quality import op4_quality
from .op5_language import op5_language_id
from .op6_secrets import op6_secret_scan
from .op7_suffix import op7_suffix_array_dedup
from .op8_packing import op8_retrieval_packing
from .op9_topk import op9_dual_tree_topk
from .op10_toxicity import op10_toxicity
from .op11_codes import op11_vector_codes
from .op12_simhash import op12_simhash_near_dedup
from .op13_resampling import op13_importance_resampling


def queries() -> dict:
    each = (
        op1_substring_dedup, op2_minhash_near_dedup, op3_benchmark_decontamination, op4_quality, op5_language_id, op6_secret_scan, op7_suffix_array_dedup, op8_retrieval_packing,
        op9_dual_tree_topk, op10_toxicity, op11_vector_codes, op12_simhash_near_dedup, op13_importance_resampling,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": op3_decontamination.ORACLE,
        "op9_dual_tree_topk": op9_topk.ORACLE,
        "op11_vector_codes": op11_codes.ORACLE,
        "op13_importance_resampling": op13_resampling.ORACLE,
    }
