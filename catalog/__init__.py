"""Registered queries over the driver tables, each with its DuckDB oracle."""

from importlib import import_module

MODULES = ["text_queries", "gate_queries", "report_queries", "table_queries", "flow_queries"]


def all_queries():
    """Every registered query by name."""
    from .base import REGISTRY
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
