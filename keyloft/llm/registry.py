"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from keyloft.llm import chat, classifier, decontamination, language, minhash, packing, quality_rules, sharding, tokens, warc

QUERIES = {
    "op1_perspective_rotation": chat.op1_perspective_rotation,
    "op2_quality_classifier": classifier.op2_quality_classifier,
    "op3_warc_chunked_records": warc.op3_warc_chunked_records,
    "op4_language_evidence": language.op4_language_evidence,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_karmarkar_karp_sharding": sharding.op8_karmarkar_karp_sharding,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
}

#: DuckDB SQL with the same result. Where SQL can't express a query, tests/llm compares it with brute force.
ORACLE = {
    "op1_perspective_rotation": chat.OP1_SQL,
    "op3_warc_chunked_records": warc.OP3_SQL,
    "op5_minhash_near_dedup": minhash.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
}
