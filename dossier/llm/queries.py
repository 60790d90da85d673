"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from dossier.llm import chat, contamination, mixing, packing, quality, repeats, runs, simhash, token_counts, token_store, toxicity, warc, whitening

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_contained_items": contamination.op2_contained_items,
    "op3_toxicity_scores": toxicity.op3_toxicity_scores,
    "op4_repeated_bytes": repeats.op4_repeated_bytes,
    "op5_perspective_chats": chat.op5_perspective_chats,
    "op6_edited_token_counts": token_counts.op6_edited_token_counts,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_token_files": token_store.op10_token_files,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_whitened_embeddings": whitening.op12_whitened_embeddings,
    "op13_packed_sequences": packing.op13_packed_sequences,
}

ORACLE_SQL = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_contained_items": contamination.OP2_SQL,
    "op5_perspective_chats": chat.OP5_SQL,
    "op7_warc_round_trip": warc.OP7_SQL,
}
