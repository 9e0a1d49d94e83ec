"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import decontaminate, mixing, neighbours, passages, private, quality, secrets, simhash, suffixes, tokens

QUERIES = {
    "op1_tokens": tokens.op1_tokens,
    "op2_mixing": mixing.op2_mixing,
    "op3_secrets": secrets.op3_secrets,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_passages": passages.op6_passages,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_private": private.op8_private,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
}
SQL = {
    "op2_mixing": mixing.SQL,
    "op3_secrets": secrets.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op7_suffixes": suffixes.SQL,
    "op8_private": private.SQL,
}
