"""The subpackage's queries and their SQL, as the entry module adds them."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, near_dedup, packing, quality, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_minhash_dedup": near_dedup.query,
    "op3_packing": packing.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_quality": quality.query,
    "op7_decontaminate": decontaminate.query,
    "op8_token_files": token_files.query,
    "op9_language_id": language_id.query,
    "op10_token_counts": token_counts.query,
}
ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_minhash_dedup": near_dedup.ORACLE_SQL,
    "op3_packing": packing.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
}
