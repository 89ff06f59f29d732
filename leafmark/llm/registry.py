"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import audio, bpe, chat, importance, lexical, mixing, neardup, ngrams, packing, passages, quality, sharding, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_audio_features": audio.op1_audio_features,
        "op2_gradient_boosted_urls": urls.op2_gradient_boosted_urls,
        "op3_schema_fingerprint": chat.op3_schema_fingerprint,
        "op4_robust_outliers": quality.op4_robust_outliers,
        "op5_consistent_ring": sharding.op5_consistent_ring,
        "op6_simhash_vantage": neardup.op6_simhash_vantage,
        "op7_kneser_ney": ngrams.op7_kneser_ney,
        "op8_first_fit_packing": packing.op8_first_fit_packing,
        "op9_phrase_automata": passages.op9_phrase_automata,
        "op10_entropy_mix": mixing.op10_entropy_mix,
        "op11_sort_count_resampling": importance.op11_sort_count_resampling,
        "op12_pair_occurrence_bpe": bpe.op12_pair_occurrence_bpe,
        "op13_threshold_search": lexical.op13_threshold_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_schema_fingerprint": chat.OP3_SQL, "op9_phrase_automata": passages.OP9_SQL, "op11_sort_count_resampling": importance.OP11_SQL, "op13_threshold_search": lexical.OP13_SQL}
