"""Queries of the training-data operators, by name, and the SQL they are held against."""

from __future__ import annotations

from . import op1_quality_classifier, op2_near_dedup, op3_sharding, op4_line_dedup, op5_lm_scoring, op6_packing, op7_audio, op8_mixing, op9_quality_rules, op10_secret_scan

_MODULES = (op1_quality_classifier, op2_near_dedup, op3_sharding, op4_line_dedup, op5_lm_scoring, op6_packing, op7_audio, op8_mixing, op9_quality_rules, op10_secret_scan)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
