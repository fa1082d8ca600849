"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import byte_dedup, chat, cost_packing, crc_resampling, decontaminate, exact_dedup, importance, language, maxent, packing, prefix_trie, simhash, word_dedup

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_chat_examples": chat.query,
    "op4_simhash": simhash.query,
    "op5_best_fit_packing": packing.query,
    "op6_importance": importance.query,
    "op7_maxent": maxent.query,
    "op8_byte_dedup": byte_dedup.query,
    "op9_word_dedup": word_dedup.query,
    "op10_language": language.query,
    "op11_cost_packing": cost_packing.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_crc_resampling": crc_resampling.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_chat_examples": chat.SQL,
    "op8_byte_dedup": byte_dedup.SQL,
    "op9_word_dedup": word_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_crc_resampling": crc_resampling.SQL,
}
