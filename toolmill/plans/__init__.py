"""Registered queries: every operator over the given tables, with its check."""

import importlib
import pkgutil

from toolmill.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "ORACLES"]
