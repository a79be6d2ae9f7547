"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from loomgraph.llm import (
    op1_line_dedup,
    op10_secret_scan,
    op2_token_store,
    op3_exact_dedup,
    op4_best_fit_packing,
    op5_token_counts,
    op6_simhash,
    op7_spotsigs,
    op8_quality,
    op9_mixing,
)

_OPS = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_spotsigs": op7_spotsigs,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
}

QUERIES = {name: module.query for name, module in _OPS.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: module.ORACLE_SQL for name, module in _OPS.items() if getattr(module, "ORACLE_SQL", None)}
