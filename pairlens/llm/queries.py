"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bpe_lexicon, decontamination, fill_in_middle, jaccard_join, knn_join, lang_id, piece_codec, ranked_search, sharding, substring_dedup, token_count, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup, url_filter.op2_url_filters, jaccard_join.op3_ngram_jaccard_join, lang_id.op4_language_id, decontamination.op5_benchmark_decontamination,
        token_count.op6_token_counts, sharding.op7_sharding, sharding.sharding_layout, bpe_lexicon.op8_bpe_codec, warc.op9_warc_audit, knn_join.op10_topk_search,
        fill_in_middle.op11_fill_in_middle, piece_codec.op12_sentencepiece_codec, ranked_search.op13_ranked_search,
    )
}

SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL, "op2_url_filters": url_filter.OP2_SQL, "op3_ngram_jaccard_join": jaccard_join.OP3_SQL, "op5_benchmark_decontamination": decontamination.OP5_SQL,
    "op7_sharding": sharding.OP7_SQL, "op9_warc_audit": warc.OP9_SQL, "op10_topk_search": knn_join.OP10_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL, "op13_ranked_search": ranked_search.OP13_SQL,
}
