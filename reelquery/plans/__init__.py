"""Composed searches and indexing runs, and the registered queries."""

from importlib import import_module

GROUPS = [
    "source_queries", "filter_queries", "join_queries", "report_queries", "order_queries", "hybrid_queries", "upsert_queries", "function_queries", "text_queries", "temporal_queries", "job_queries", "stream_queries",
]


def load() -> None:
    for group in GROUPS:
        import_module(f"reelquery.plans.{group}")
