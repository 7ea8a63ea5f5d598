"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from . import alignment, ctw, decontaminate, gif, htmltext, intervals, packing, pieces, pii, quality, secrets, simhash, toxicity

QUERIES = {
    "op1_quality_ordinal": quality.query,
    "op2_secret_markov": secrets.query,
    "op3_packing_dp": packing.query,
    "op4_simhash_bytes": simhash.query,
    "op5_toxicity_weak": toxicity.query,
    "op6_decontam_lsi": decontaminate.query,
    "op7_media_gif": gif.query,
    "op8_pii_boost": pii.query,
    "op9_html_suffix": htmltext.query,
    "op10_lm_ctw": ctw.query,
    "op11_align_merge": alignment.query,
    "op12_pieces_offsets": pieces.query,
    "op13_overlap_fenwick": intervals.query,
}
#: SQL can't express the fitted models, tokenizers and searches; tests hold those queries against brute force.
ORACLE: dict[str, str] = {"op13_overlap_fenwick": intervals.SQL}
