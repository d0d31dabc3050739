"""Queries of the training-data operators, one per operator, and SQL oracles where SQL can say it."""

from __future__ import annotations

from factspan.llm import alignment, decontaminate, langid, lbl, merkle, multi_index, ngram_join, packing, pii, preferences, rules, secrets, weak_quality

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii_skip_chain,
        weak_quality.op2_weak_quality,
        preferences.op3_preference_pairs,
        rules.op4_rules_weak_supervision,
        decontaminate.op5_winnowing,
        packing.op6_pack_matching,
        secrets.op7_secret_structure,
        langid.op8_language_backoff,
        lbl.op9_log_bilinear,
        ngram_join.op10_ngram_jaccard,
        alignment.op11_elementary_intervals,
        merkle.op12_merkle_manifest,
        multi_index.op13_inverted_multi_index,
    )
}
ORACLES: dict[str, str] = {
    "op3_preference_pairs": preferences.ORACLE,
    "op5_winnowing": decontaminate.ORACLE,
    "op10_ngram_jaccard": ngram_join.ORACLE,
}
