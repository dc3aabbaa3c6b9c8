"""The queries and SQL of this subpackage, by name."""

from factlens.llm import bpe, centroids, divergence, jaccard, packing, quality, sharding, substrings, templates, tokens, toxicity, urls

QUERIES = {
    "op1_virtual_slots": sharding.op1_virtual_slots,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_template_decontamination": templates.op5_template_decontamination,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_lines": quality.op8_quality_lines,
    "op9_token_matrices": packing.op9_token_matrices,
    "op10_url_filter": urls.op10_url_filter,
    "op11_bpe_trie": bpe.op11_bpe_trie,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE = {
    "op3_substring_dedup": substrings.OP3_SQL,
    "op4_jaccard_join": jaccard.OP4_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
