"""The queries of this subpackage, and their SQL."""

from plumbline.llm import chat, exact_dedup, language_id, lattice, mixing, packing, recompression, simhash, suffix_dedup, vector_search

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_vector_search": vector_search.op5_vector_search,
    "op6_simhash": simhash.op6_simhash,
    "op7_substring_dedup": recompression.op7_substring_dedup,
    "op8_lm_scoring": lattice.op8_lm_scoring,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op2_chat": chat.ORACLE_SQL,
    "op5_vector_search": vector_search.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
