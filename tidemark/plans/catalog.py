"""Loads every plan module and hands out what they registered."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

MODULES = ["market", "point_in_time", "portfolios", "disclosures", "weather", "tables", "gates", "elements", "contracts"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
