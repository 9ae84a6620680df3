"""Queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)


def flagship(spark, sf):
    _load()
    return QUERIES["document_risk"](spark, sf)
