"""Registered queries and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    """Imports the modules that register queries."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
