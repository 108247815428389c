"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import exact, html, lines, lm, minhash, mixing, neighbours, pieces, pii, sharding, toxicity, trie, whitening

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_mixing": mixing.op5_mixing,
    "op6_personal_data": pii.op6_personal_data,
    "op7_embedding_dedup": neighbours.op7_embedding_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op3_line_dedup": lines.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op10_exact_dedup": exact.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
