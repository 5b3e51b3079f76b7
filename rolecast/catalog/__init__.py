"""Registered queries: each runs an operator over the whole given tables.

A query takes (spark, sf_dir). Its SQL, when it has one, gives the same columns and
rows from the same tables.
"""

from importlib import import_module

from rolecast.catalog.base import ORACLE, QUERIES

for _theme in ("terms", "match", "freshness", "state", "ingest", "report", "streams", "flow", "landed"):
    import_module(f"rolecast.catalog.{_theme}")

__all__ = ["ORACLE", "QUERIES"]
