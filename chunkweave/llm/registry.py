"""All queries of this sub-package."""

from __future__ import annotations

import importlib
import pkgutil


def _modules() -> list:
    import chunkweave.llm as here

    return [importlib.import_module(f"{here.__name__}.{m.name}") for m in pkgutil.iter_modules(here.__path__) if m.name.startswith("queries_")]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.SQL.items()}
