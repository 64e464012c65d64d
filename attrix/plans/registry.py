"""Query registry: name -> (Spark builder, DuckDB oracle SQL).

Each plan module registers its queries with ``@query(name, sql, views)``.
Names follow the operator ids of the design survey (e.g. ``evl3_roc_auc``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attrix.plans.sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    import pkgutil

    import attrix.plans as pkg

    for m in sorted(pkgutil.iter_modules(pkg.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"attrix.plans.{m.name}")
