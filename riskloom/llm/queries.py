"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from riskloom.llm import (
    language_id, licences, merkle, minhash, mixing, packing, pii, quality_classifier, quality_rules, sharding, spelling, url_filter,
    vector_dedup,
)

QUERIES = {
    "op1_vector_dedup": vector_dedup.op1_vector_dedup,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_minhash": minhash.op6_minhash,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_licences": licences.op10_licences,
    "op11_spelling": spelling.op11_spelling,
    "op12_sharding": sharding.op12_sharding,
    "op13_merkle": merkle.op13_merkle,
}

#: DuckDB SQL over the driver's tables, where SQL expresses the operator's whole result.
ORACLE = {
    "op1_vector_dedup": vector_dedup.OP1_SQL,
    "op4_url_filters": url_filter.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op10_licences": licences.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
