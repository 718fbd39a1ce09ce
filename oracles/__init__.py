"""Independent DuckDB text for the operator queries."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in pkgutil.iter_modules(__path__):
        mod = importlib.import_module(f"{__name__}.{m.name}")
        out.update(getattr(mod, "SQL", {}))
    return out
