"""Registered queries, grouped by area."""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "event_queries", "feature_queries", "timeline_queries", "metric_queries", "ops_queries", "model_queries", "stream_queries",
]


def load():
    """Import every area and return the catalog module."""
    for area in AREAS:
        import_module(f"reviewrank.plans.{area}")
    return import_module("reviewrank.plans.catalog")
