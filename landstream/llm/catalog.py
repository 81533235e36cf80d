"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import centroid_clusters, decontamination, embedding_dedup, filter_audit, html_text, language_id, mixing, ngram_join, suffix_dedup, token_counts, toxicity, url_rules, warc

QUERIES = {
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op9_url_rules": url_rules.op9_url_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_html_text": html_text.op12_html_text,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}

ORACLES = {
    "op1_warc_revisits": warc.SQL,
    "op2_ngram_join": ngram_join.SQL,
    "op3_mix_sources": mixing.SQL,
    "op6_embedding_dedup": embedding_dedup.SQL,
    "op9_url_rules": url_rules.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_centroid_clusters": centroid_clusters.SQL,
}
