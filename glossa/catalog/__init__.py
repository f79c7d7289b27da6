"""Registered queries, one module per operator family."""

from importlib import import_module

from glossa.catalog.registry import QUERIES

_MODULES = ["scalars", "filters", "aggregates", "sources", "joins", "ordering", "scoring", "streams"]
for _name in _MODULES:
    import_module(f"glossa.catalog.{_name}")

__all__ = ["QUERIES"]
