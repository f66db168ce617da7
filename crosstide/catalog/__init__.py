"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["panel_ops", "rolling_ops", "factor_sets", "metric_ops", "library_ops", "pool_ops", "graph_ops"]


def load():
    """(queries, SQL twins) of every catalog module."""
    for module in MODULES:
        importlib.import_module(f"crosstide.catalog.{module}")
    from crosstide.catalog.common import ORACLES, QUERIES

    return QUERIES, ORACLES
