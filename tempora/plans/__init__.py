"""Operators bound to the supplied tables, one query per entry of the operator inventory."""

import importlib

GROUPS = ("time_joins", "movement_tables", "peri_event", "describing", "statistics", "files", "resampling", "streams")


def all_queries():
    """(queries, oracles) of every group."""
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
    from tempora.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
