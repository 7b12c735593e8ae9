"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from caseloom.llm import ann, exact, linedup, mixing, neardup, negatives, packing, quality, sharding, tokcount, tokenfile, toxicity, trie

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_bin_completion": packing.op2_bin_completion,
    "op3_coordinate_join": neardup.op3_coordinate_join,
    "op4_golomb_exact": exact.op4_golomb_exact,
    "op5_additive_quantisation": ann.op5_additive_quantisation,
    "op6_prefix_counts": tokcount.op6_prefix_counts,
    "op7_histogram_sort": sharding.op7_histogram_sort,
    "op8_patience_lines": linedup.op8_patience_lines,
    "op9_orc_tokens": tokenfile.op9_orc_tokens,
    "op10_noisy_or": toxicity.op10_noisy_or,
    "op11_multi_index": negatives.op11_multi_index,
    "op12_cascade": quality.op12_cascade,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLES = {
    "op1_pareto_mix": mixing.ORACLE,
    "op3_coordinate_join": neardup.ORACLE,
    "op4_golomb_exact": exact.ORACLE,
    "op11_multi_index": negatives.ORACLE,
    "op12_cascade": quality.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
