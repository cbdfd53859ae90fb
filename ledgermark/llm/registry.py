"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgermark.llm import languages, lattice, lines, mixing, periods, pieces, privacy, quality, simhash, suffixes, toolcalls, topk, tries

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_pii_surrogates": privacy.op2_pii_surrogates,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_tool_calls": toolcalls.op4_tool_calls,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_embedding_near_dedup": lattice.op7_embedding_near_dedup,
    "op8_quality": quality.op8_quality,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_prefix_trie": tries.op12_prefix_trie,
    "op13_language": languages.op13_language,
}
SQL = {
    "op3_suffix_dedup": suffixes.OP3_SQL,
    "op4_tool_calls": toolcalls.OP4_SQL,
    "op7_embedding_near_dedup": lattice.OP7_SQL,
    "op9_exact_top_k": topk.OP9_SQL,
    "op11_periodic_runs": periods.OP11_SQL,
    "op12_prefix_trie": tries.OP12_SQL,
}
