"""The registered queries of this subpackage, one thin query for each operator."""

from __future__ import annotations

from . import bpe, ctw, ego, html_text, jaccard, mixing, quality, toxicity, vptree, warc

QUERIES = {
    "op1_ctw_scoring": ctw.op1_ctw_scoring,
    "op2_epsilon_grid_join": ego.op2_epsilon_grid_join,
    "op3_html_lstm": html_text.op3_html_lstm,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_vptree_search": vptree.op8_vptree_search,
    "op9_quality_qda": quality.op9_quality_qda,
    "op10_toxicity_ftrl": toxicity.op10_toxicity_ftrl,
}

ORACLES = {
    "op4_warc_salvage": warc.ORACLE.format(pages="pages"),
    "op5_mix_sources": mixing.ORACLE.format(documents="documents"),
}
