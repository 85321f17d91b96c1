"""Registered queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

MODULES = ("market", "cross", "intraday", "evaluation", "hypothesis", "risk", "forecast", "spillover", "drift", "streams", "many")


def load():
    """All registered queries by name."""
    from barograph.plans.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"barograph.plans.{m}")
    return QUERIES
