"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from ..ship import shipped
from . import op1_minhash, op2_warc, op3_vptree, op4_decontam, op5_phrases, op6_license, op7_packing, op8_lines, op9_langid, op10_suffix

_QUERIES = {
    "op1_minhash": op1_minhash.op1_minhash,
    "op2_warc": op2_warc.op2_warc,
    "op3_vptree": op3_vptree.op3_vptree,
    "op4_decontam": op4_decontam.op4_decontam,
    "op5_phrases": op5_phrases.op5_phrases,
    "op6_license_scan": op6_license.op6_license_scan,
    "op7_packing": op7_packing.op7_packing,
    "op8_line_dedup": op8_lines.op8_line_dedup,
    "op10_suffix": op10_suffix.op10_suffix,
    "op9_langid": op9_langid.op9_langid,
    "langid_pages": op9_langid.langid_pages,
}
QUERIES = {name: shipped(query) for name, query in _QUERIES.items()}
ORACLE_SQL = {
    "op1_minhash": op1_minhash.ORACLE,
    "op2_warc": op2_warc.ORACLE,
    "op3_vptree": op3_vptree.ORACLE,
    "op5_phrases": op5_phrases.ORACLE,
    "op10_suffix": op10_suffix.ORACLE,
    "op8_line_dedup": op8_lines.ORACLE,
}
