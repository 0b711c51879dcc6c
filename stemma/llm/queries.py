"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import archive, chat, decontamination, extraction, licences, neardup, packing, pii, quality, substrings
from .common import discard  # noqa: F401  for the bench, between queries

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_pack": packing.op2_pack,
    "op3_jaccard_join": neardup.op3_jaccard_join,
    "op4_extract": extraction.op4_extract,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_chat": chat.op8_chat,
    "op9_repeats": substrings.op9_repeats,
    "op10_warc": archive.op10_warc,
}
ORACLE_SQL = {
    "op1_licences": licences.OP1_SQL,
    "op3_jaccard_join": neardup.OP3_SQL,
    "op6_decontaminate": decontamination.OP6_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_warc": archive.OP10_SQL,
}
