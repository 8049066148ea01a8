"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessella.llm import chat, contamination, langid, mixing, nearcopies, quality, repeats, tokens, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_rules": quality.op2_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_urls": urls.op4_urls,
    "op5_nearcopies": nearcopies.op5_nearcopies,
    "op6_repeats": repeats.op6_repeats,
    "op7_language": langid.op7_language,
    "op8_tokens": tokens.op8_tokens,
    "op9_chat": chat.op9_chat,
    "op10_contamination": contamination.op10_contamination,
}

ORACLE_SQL = {
    "op4_urls": urls.OP4_SQL,
    "op6_repeats": repeats.OP6_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_contamination": contamination.OP10_SQL,
}
