"""The queries opN_<name> over the driver's tables, and their SQL where there is one."""

from spanloom.llm import bpe, brown, decontaminate, langid, near, quality, repeats, secrets, warc, wrappers

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_bpe": bpe.op2,
    "op3_quality_rules": quality.op3,
    "op4_secret_scan": secrets.op4,
    "op5_warc": warc.op5,
    "op6_brown_scores": brown.op6,
    "op7_html_text": wrappers.op7,
    "op8_remove_repeats": repeats.op8,
    "op9_language_id": langid.op9,
    "op10_ngram_jaccard": near.op10,
    "quality_ablation": quality.quality_ablation,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op5_warc": warc.ORACLE,
    "quality_ablation": quality.ABLATION_ORACLE,
}
