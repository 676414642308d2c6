"""Queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import anisotropic, bpe, dedupindex, divergence, htmlmain, jaccardjoin, langid, licenses, mixing, pii, resampling, spotsigs, toxicity

QUERIES = {
    "op1_html_main_text": htmlmain.query,
    "op2_anisotropic_search": anisotropic.query,
    "op3_language_ppm": langid.query,
    "op4_spotsigs": spotsigs.query,
    "op5_temperature_mix": mixing.query,
    "op6_license_scan": licenses.query,
    "op7_pii_semicrf": pii.query,
    "op8_ngram_jaccard_join": jaccardjoin.query,
    "op9_bpe_replay": bpe.query,
    "op10_toxicity_ftrl": toxicity.query,
    "op11_digest_index": dedupindex.query,
    "op12_importance_resampling": resampling.query,
    "op13_source_divergence": divergence.query,
}

ORACLE: dict[str, str] = {
    "op11_digest_index": dedupindex.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_source_divergence": divergence.SQL,
}
