"""Queries of this subpackage for the driver's entry point: op1 .. op10."""

from __future__ import annotations

from .decontaminate import op8_decontamination
from .language_id import op2_language_id
from .license_scan import OP7_SQL, op7_license_scan
from .line_crf import op6_line_crf
from .near_dedup import op3_near_dedup
from .oracles import OP3, OP4, OP5, OP8
from .packing import op10_packing
from .quality_rules import OP1_SQL, op1_quality_rules
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op9_token_counts


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_language_id": op2_language_id,
        "op3_near_dedup": op3_near_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_crf": op6_line_crf,
        "op7_license_scan": op7_license_scan,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op3_near_dedup": OP3,
        "op4_substring_dedup": OP4,
        "op5_suffix_dedup": OP5,
        "op7_license_scan": OP7_SQL,
        "op8_decontamination": OP8,
    }
