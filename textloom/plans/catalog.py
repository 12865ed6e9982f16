"""All queries by name; importing it starts no session."""

from __future__ import annotations

from textloom.plans import eval_queries, log_queries, mix_queries, rank_queries, text_queries  # noqa: F401  (registers the queries)
from textloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
