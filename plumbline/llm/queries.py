"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, hmm, langid, ngram_join, quality, secrets, templates, warc, winnow

QUERIES = {
    "op1_lm_scoring": hmm.op1_lm_scoring,
    "op2_bpe": bpe.op2_bpe,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_language_id": langid.op4_language_id,
    "op5_decontamination": winnow.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_html_extraction": templates.op8_html_extraction,
    "op9_neighbours": ann.op9_neighbours,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op3_secret_scans": secrets.ORACLE,
    "op5_decontamination": winnow.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_ngram_jaccard": ngram_join.ORACLE,
}
