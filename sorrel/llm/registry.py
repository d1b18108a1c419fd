"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from . import audio_features, bpe_codec, chat_format, exact_dedup, hnsw_search, language_id, packing, prefix_trie, simhash_dedup, token_counts, tokenizer_alignment, url_filters, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_packing": packing.op6_packing,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_audio_features": audio_features.op8_audio_features,
    "op9_simhash": simhash_dedup.op9_simhash,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_tokenizer_alignment": tokenizer_alignment.op12_tokenizer_alignment,
    "op13_nearest_neighbours": hnsw_search.op13_nearest_neighbours,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_url_filters": url_filters.OP5_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
