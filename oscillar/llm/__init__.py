"""Operators for training-data corpora, their queries and SQL."""

from oscillar.llm import decontamination, divergence, exact_dedup, filter_audit, html_text, jaccard_join, mixing, sharding, simhash, substring_dedup, token_output, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_html_text": html_text.op6_html_text,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_shard": sharding.op8_shard,
    "op9_token_output": token_output.op9_token_output,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_simhash_dedup": simhash.op12_simhash_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_warc": warc.SQL,
    "op3_decontaminate": decontamination.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_mix_sources": mixing.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_source_divergence": divergence.SQL,
}
