"""Operators of a training-data pipeline, their queries and their SQL."""

from runfold.llm import alignment, chat, exact_dedup, flat_graph, langid, licences, mixing, pieces, pii, quality, simhash, trie, wrapper

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_format_chats": chat.op3_format_chats,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_personal_data": pii.op5_personal_data,
    "op6_main_text": wrapper.op6_main_text,
    "op7_sample_pieces": pieces.op7_sample_pieces,
    "op8_simhash": simhash.op8_simhash,
    "op9_licence_scan": licences.op9_licence_scan,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_align_tokens": alignment.op11_align_tokens,
    "op12_embedding_dedup": flat_graph.op12_embedding_dedup,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_format_chats": chat.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
