"""Checked query catalogue: every registered query and its SQL twin."""

from __future__ import annotations

import importlib

from parley.plans.registry import ORACLES, QUERIES

_MODULES = ("conversation", "sources", "features", "sequences", "evaluation", "normalize", "models", "streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"parley.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
