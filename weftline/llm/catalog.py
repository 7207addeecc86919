"""All queries of the training-data operators: name -> (callable, SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil

import weftline.llm as here

# imported here, so that a missing package shows when the catalogue is imported
_NAMES = [m.name for m in pkgutil.iter_modules(here.__path__) if m.name[0] == "p" and m.name[1:2].isdigit()]
_MODULES = [importlib.import_module(f"{here.__name__}.{name}") for name in sorted(_NAMES, key=lambda n: int(n[1:].split("_")[0]))]
_ENTRIES: dict = {k: v for module in _MODULES for k, v in module.QUERIES.items()}


def queries() -> dict:
    return {k: f for k, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _ENTRIES.items() if s}
