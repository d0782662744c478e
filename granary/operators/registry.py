"""All registered queries of the library, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Modules of ``granary.operators`` that register queries with ``Catalog``.
MODULES: tuple[str, ...] = ("overlap", "scoring", "stats", "sampling", "dedup", "filters", "relational", "tree", "io", "generators", "streams", "mixtures", "readouts", "nodes", "records", "debias", "solutions", "phrases", "controls", "converters", "rules", "contrasts")


def _catalogs():
    for name in MODULES:
        yield import_module(f"granary.operators.{name}").CATALOG


def queries() -> dict:
    return {name: q.build for c in _catalogs() for name, q in c.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for c in _catalogs() for name, q in c.items() if q.sql}
