"""The registry of queries and their DuckDB counterparts."""

from __future__ import annotations

from heron.plans import q_curate, q_eval, q_metrics, q_rules, q_text, q_vectors
from heron.plans.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "q_curate", "q_eval", "q_metrics", "q_rules", "q_text", "q_vectors"]


def flagship(spark, sf_dir):
    """Phase-1 verdicts: their counts, mean scores and redactions."""
    return QUERIES["verdict_distribution"](spark, sf_dir)
