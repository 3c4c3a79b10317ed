"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from quantloom.llm import ann, chat, exact_dedup, filter_audit, line_dedup, mixing, packing, quality, sharding, simhash, token_alignment, token_files, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_ann": ann.op4_ann,
    "op5_token_files": token_files.op5_token_files,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
