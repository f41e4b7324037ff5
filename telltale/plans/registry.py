"""All registered queries: name -> (Spark function, SQL twin or None)."""
from __future__ import annotations

import importlib

MODULES = ("fleet", "streams", "cases", "signals", "texts", "places", "runs", "models", "validation", "live", "identity")


def catalog() -> dict:
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"telltale.plans.{name}").QUERIES)
    return found
