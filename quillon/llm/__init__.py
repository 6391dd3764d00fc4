"""Operators for preparing training text. `QUERIES` and `ORACLES` are what __spark_entry__ registers."""

from quillon.llm import bpe, exact_dedup, language_id, neighbours, ngram_join, packing, pii, recompression_dedup, secrets, suffix_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_nearest": neighbours.op2_nearest,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_recompression_dedup": recompression_dedup.op8_recompression_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op5_exact_dedup": exact_dedup.ORACLE}
