"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, exact, infill, knn, langid, media, merkle, mixing, ngram_join, pack, passages, urls, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
        "op2_warc_segments": warc.op2_warc,
        "op3_mix_to_targets": mixing.op3_mix_to_targets,
        "op4_repeated_passages": passages.op4_repeated_passages,
        "op5_exact_dedup": exact.op5_exact_dedup,
        "op6_mixture_packing": pack.op6_mixture_packing,
        "op7_media_sniffing": media.op7_media_sniffing,
        "op8_reply_trees": chat.op8_reply_trees,
        "op9_quality_knn": knn.op9_quality,
        "op10_language_id": langid.op10_language_id,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_url_filter": urls.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_join.OP1_SQL, "op3_mix_to_targets": mixing.mix_sql(), "op5_exact_dedup": exact.OP5_SQL, "op8_reply_trees": chat.OP8_SQL, "op11_merkle_manifest": merkle.op11_sql(), "op12_fill_in_middle": infill.OP12_SQL}
