"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from foldlog.llm import attention_lm, bpe, cws, jaccard, langid, packing, quality, substrings, toxicity, warc

QUERIES = {
    "op1_warc_derivatives": warc.query,
    "op2_bpe_codec": bpe.query,
    "op3_attention_lm": attention_lm.query,
    "op4_cws_fingerprints": cws.query,
    "op5_language_id": langid.query,
    "op6_quality_forest": quality.query,
    "op7_ngram_jaccard_join": jaccard.query,
    "op8_substring_dedup": substrings.query,
    "op9_toxicity_nnpu": toxicity.query,
    "op10_best_fit_packing": packing.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": warc.oracle(),
    "op7_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op8_substring_dedup": substrings.ORACLE_SQL,
}
