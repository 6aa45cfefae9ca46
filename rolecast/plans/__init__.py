"""Derived input tables, composed jobs and the registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("scalar_queries", "text_queries", "feature_queries", "screen_queries", "ranking_queries", "source_queries")


def load_queries():
    """All registered queries and their checking SQL."""
    from rolecast.plans.registry import ORACLES, QUERIES

    for name in _MODULES:
        importlib.import_module(f"rolecast.plans.{name}")
    return QUERIES, ORACLES
