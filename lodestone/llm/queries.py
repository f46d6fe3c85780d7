"""The registered queries of the corpus operators."""

from __future__ import annotations

from lodestone.llm import fingerprint, gif, jaccard, lm, mixing, negatives, pieces, pii, setsketch, suffix, toxicity, twins, warc, whitening

QUERIES = {
    "op3_suffix_dedup": suffix.query,
    "op9_ngram_jaccard": jaccard.query,
    "op8_lm_score": lm.query,
    "op5_sentencepiece": pieces.query,
    "op1_pii": pii.query,
    "op2_mix_sources": mixing.query,
    "op4_gif_media": gif.query,
    "op6_fingerprints": fingerprint.query,
    "op7_warc_archive": warc.query,
    "op10_toxicity": toxicity.query,
    "op11_hard_negatives": negatives.query,
    "op12_setsketch_dedup": setsketch.query,
    "op13_whitening": whitening.query,
    "op9_jaccard_pairs": jaccard.pair_query,
    "op9_jaccard_links": jaccard.count_query,
} | twins.QUERIES
ORACLES = {"op7_warc_archive": warc.ORACLE, "op11_hard_negatives": negatives.ORACLE} | twins.ORACLES
