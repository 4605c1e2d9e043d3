"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from . import bpe, ctw, decontaminate, exact_dedup, licenses, line_dedup, merkle, ngram_join, preference, quality, spelling, toxicity, url_filter

QUERIES = {
    "op1_ctw": ctw.op1_ctw,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_preference_format": preference.op5_preference_format,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "ctw_base": ctw.ctw_base,
    "quality_base": quality.quality_base,
}
#: SQL cannot express the models of 1, 3 and 8 nor the encoding of 10: what it can of 1 and 3 are queries of their own, 8 is
#: held against a naive scan, 10 against the tokenizer itself.
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_preference_format": preference.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op4_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
    "ctw_base": ctw.ORACLE,
    "quality_base": quality.ORACLE,
}
