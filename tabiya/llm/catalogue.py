"""The training-data queries and the DuckDB SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tabiya.llm import dialogue_repair, fill_in_middle, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, token_counts, topk, url_filters, warc, weak_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_classifier": weak_labels.op4_quality_classifier,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
    "op11_dialogue_repair": dialogue_repair.op11_dialogue_repair,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_warc": warc.op13_warc,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_warc": warc.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
