"""The queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from lakemill.llm import bpe, conversation_repair, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, url_filter, vector_search, whitening


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_bpe": bpe.op7_bpe,
        "op8_vector_search": vector_search.op8_vector_search,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_sharding": sharding.op10_sharding,
        "op11_whitening": whitening.op11_whitening,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.SQL,
        "op4_url_filter": url_filter.SQL,
        "op6_jaccard_join": jaccard_join.SQL,
        "op9_quality_rules": quality_rules.SQL,
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
