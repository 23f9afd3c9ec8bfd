"""Registered queries: importing the modules fills the registry."""

from importlib import import_module

from fellscape.queries.registry import QUERIES, SQL

MODULES = ["cleaning", "sampling", "selection", "functions", "landscape", "analysis"]


def load() -> None:
    for name in MODULES:
        import_module(f"fellscape.queries.{name}")


__all__ = ["QUERIES", "SQL", "load"]
