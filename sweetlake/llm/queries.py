"""Queries of the training-data operators."""

from __future__ import annotations

from . import alignment, byte_bpe, chat, graph_search, merkle, near_dedup, packing, pii, quality, substrings, token_store, voronoi_join, warc

QUERIES = {
    "op1_bootstrapped_pii": pii.personal_data,
    "op2_factorisation_machine": quality.scored,
    "op3_pruned_graph": graph_search.neighbours,
    "op4_voronoi_join": voronoi_join.exact,
    "op5_warc_chunks": warc.archive,
    "op6_pack_first_fit": packing.packed,
    "op7_token_files": token_store.token_files,
    "op8_prefix_targets": chat.chat,
    "op9_byte_bpe": byte_bpe.round_trip,
    "op10_super_min_hash": near_dedup.near_duplicates,
    "op11_subtree_exchange": merkle.proofs,
    "op12_interval_coalescing": alignment.aligned,
    "op13_relative_parsing": substrings.deduped,
}
ORACLES: dict[str, str] = {
    "op4_voronoi_join": voronoi_join.EXACT_SQL,
    "op8_prefix_targets": chat.CHAT_SQL,
    "op11_subtree_exchange": merkle.PROOFS_SQL,
    "op13_relative_parsing": substrings.DEDUPED_SQL,
}
