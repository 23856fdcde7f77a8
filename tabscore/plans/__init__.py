"""Registered queries and the ready-made benchmarks."""

from tabscore.plans import q_closed, q_explain, q_features, q_models, q_profile, q_scores, q_suites, q_tables  # noqa: F401
from tabscore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
