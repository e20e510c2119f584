"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from glyphflow.llm import bwt, partenum, preference, rules, secrets, toxicity, warczip, winnow
from glyphflow.llm.bpe import op2_byte_bpe
from glyphflow.llm.fertility import op1_fertility_quality

QUERIES = {
    "op1_fertility_quality": op1_fertility_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_rule_quality": rules.op3_rule_quality,
    "op4_toxic_segments": toxicity.op4_toxic_segments,
    "op5_warc_zip": warczip.op5_warc_zip,
    "op6_winnow_decontaminate": winnow.op6_winnow_decontaminate,
    "op7_bwt_dedup": bwt.op7_bwt_dedup,
    "op8_partenum_join": partenum.op8_partenum_join,
    "op9_preference_format": preference.op9_preference_format,
    "op10_pfa_secrets": secrets.op10_pfa_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_zip": warczip.SQL,
    "op6_winnow_decontaminate": winnow.SQL,
    "op8_partenum_join": partenum.SQL,
    "op9_preference_format": preference.SQL,
}
