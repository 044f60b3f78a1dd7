"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, language, line_dedup, packing, parity_join, quality_rules, reshard, site_quality, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_reshard": reshard.op2_reshard,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_files": token_files.op4_token_files,
    "op5_language": language.op5_language,
    "op6_site_quality": site_quality.op6_site_quality,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_parity_join": parity_join.op10_parity_join,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.SQL,
    "op6_site_quality": site_quality.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
