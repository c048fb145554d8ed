"""Operators for preparing training text; nothing else in the library imports this subpackage."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a query (spark, sf_dir) -> DataFrame under ``name``, with its SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    """Imports every query module so that it registers itself."""
    for module in iter_modules(__path__):
        if module.name.endswith("_query"):
            import_module(f"{__name__}.{module.name}")
