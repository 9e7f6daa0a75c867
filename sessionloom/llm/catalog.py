"""Named queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from sessionloom.llm import automata, divergence, extraction, hnsw, language, mixing, packing, simhash, suffixes, token_counts, topk, toxicity, vafile

QUERIES = {
    "op1_hnsw": hnsw.op1_hnsw,
    "op2_topk": topk.op2_topk,
    "op3_language": language.op3_language,
    "op4_main_text": extraction.op4_main_text,
    "op5_edit_counts": token_counts.op5_edit_counts,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fair_mix": mixing.op8_fair_mix,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_va_clusters": vafile.op11_va_clusters,
    "op12_divergence": divergence.op12_divergence,
    "op13_automata": automata.op13_automata,
}

SQL = {
    "op1_hnsw": hnsw.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op8_fair_mix": mixing.OP8_SQL,
    "op11_va_clusters": vafile.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_automata": automata.OP13_SQL,
}
