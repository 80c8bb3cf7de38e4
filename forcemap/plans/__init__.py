"""Registered queries: each operator run over whole tables, with its SQL twin."""

from __future__ import annotations

import importlib
import importlib.util

from forcemap.plans.registry import ORACLES, QUERIES

MODULES = [
    "scalars",
    "maps",
    "timejoins",
    "scorecards",
    "aggregates",
    "windows",
    "ranking",
    "comparison",
    "trends",
    "accounts",
    "quality",
    "tables",
    "state",
    "streams",
]


def load_all() -> None:
    for name in MODULES:
        if importlib.util.find_spec(f"forcemap.plans.{name}"):
            importlib.import_module(f"forcemap.plans.{name}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
