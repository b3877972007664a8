"""Registered queries of this subpackage."""

from . import decontaminate, langid, linededup, lmscore, mixing, paritysketch, pii, quality, spotsigs, suffixdedup

QUERIES = {
    "op1_language_id": langid.query,
    "op2_decontamination": decontaminate.query,
    "op3_quality_classifier": quality.query,
    "op4_lm_scoring": lmscore.query,
    "op5_mixing": mixing.query,
    "op6_fuzzy_line_dedup": linededup.query,
    "op7_pii": pii.query,
    "op8_suffix_array_dedup": suffixdedup.query,
    "op9_spotsigs": spotsigs.query,
    "op10_parity_sketch_join": paritysketch.query,
}
ORACLE = {"op5_mixing": mixing.SQL, "op10_parity_sketch_join": paritysketch.SQL}
