"""The training-text queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, lang_id, line_dedup, lm_score, mixing, near_dedup, packing, resample, runs, search, token_count, toxicity, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (lang_id.op1_language_id, lm_score.op2_lm_score, mixing.op3_source_mixing, line_dedup.op4_line_dedup, packing.op5_packing, ann.op6_one_bit_neighbours, near_dedup.op7_minhash_near_dedup, toxicity.op8_toxicity, search.op9_top_k_search, token_count.op10_token_counts, resample.op11_target_resampling, word_bpe.op12_word_bpe, runs.op13_periodic_runs)
}

ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_top_k_search": search.ORACLE,
    "op11_target_resampling": resample.ORACLE,
}
