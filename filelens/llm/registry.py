"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filelens.llm import best_fit, divergence, exact_dedup, fill_in_middle, language, minhash, packing, quality, secrets, sentencepiece_fst, simhash, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_fingerprints": minhash.op4_fingerprints,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_sentencepiece": sentencepiece_fst.op9_sentencepiece,
    "op10_packing": packing.op10_packing,
    "op11_best_fit": best_fit.op11_best_fit,
    "op12_divergence": divergence.op12_divergence,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_secrets": secrets.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
