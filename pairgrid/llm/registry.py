"""Queries of this subpackage: name → builder, and the DuckDB SQL where there is one."""

from __future__ import annotations

from . import bpe, collocations, conversation_repair, decontaminate, embedding_dedup, fingerprint, jaccard_join, line_dedup, main_text, privacy, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_winnow_lines": line_dedup.op2_winnow_lines,
    "op3_weak_privacy": privacy.op3_weak_privacy,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_consensus_paths": main_text.op5_consensus_paths,
    "op6_toxicity_chain": toxicity.op6_toxicity_chain,
    "op7_feistel_shards": sharding.op7_feistel_shards,
    "op8_iblt_fingerprints": fingerprint.op8_iblt_fingerprints,
    "op9_lsh_forest": jaccard_join.op9_lsh_forest,
    "op10_trie_bpe": bpe.op10_trie_bpe,
    "op11_misra_gries_phrases": collocations.op11_misra_gries_phrases,
    "op12_rotation_codes": embedding_dedup.op12_rotation_codes,
    "op13_lightest_repair": conversation_repair.op13_lightest_repair,
}
ORACLES = {
    "op2_winnow_lines": line_dedup.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op11_misra_gries_phrases": collocations.OP11_SQL,
    "op12_rotation_codes": embedding_dedup.OP12_SQL,
}
