"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (collocations, exact_dedup, language_id, near_dedup, packing, pii_sanitise, projection_forest, quality_rules,
               sentencepiece_codec, toxicity, url_filter, warc, whitening)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_pii_sanitise": pii_sanitise.op7_pii_sanitise,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_warc": warc.op10_warc,
    "op11_collocations": collocations.op11_collocations,
    "op12_ann_forest": projection_forest.op12_ann_forest,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
