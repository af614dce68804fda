"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, chat, clusters, exact_dedup, jaccard, line_dedup, minhash, packing, quality, spelling, topk, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_topk_search": topk.op10_topk_search,
    "op11_centroid_clusters": clusters.op11_centroid_clusters,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op7_warc_revisits": warc.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op9_jaccard_join": jaccard.ORACLE_SQL,
    "op10_topk_search": topk.ORACLE_SQL,
    "op11_centroid_clusters": clusters.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_minhash_dedup": minhash.ORACLE_SQL,
}
