"""Queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ("q_rules", "q_commands", "q_policy", "q_reports", "q_graph", "q_state", "q_streaming")


def all_queries():
    """``(queries, oracles)`` by name."""
    from workload import registry

    for name in _MODULES:
        importlib.import_module(f"workload.{name}")
    return registry.QUERIES, registry.ORACLES
