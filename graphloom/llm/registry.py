"""Queries of this subpackage by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from graphloom.llm import bpe, centroids, chat_format, exact_dedup, jaccard_join, mixing, periodic_runs, quality_fm, simhash, substring_dedup, syncmers, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_syncmer_fingerprints": syncmers.op4_syncmer_fingerprints,
    "op5_quality_fm": quality_fm.op5_quality_fm,
    "op6_warc": warc.op6_warc,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_simhash": simhash.op11_simhash,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {
    "op6_warc": warc.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
}
