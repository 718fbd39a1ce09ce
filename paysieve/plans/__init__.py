"""Operator queries, grouped by job."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    from paysieve.plans.registry import QUERIES

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES
