"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession


def _load():
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
    from evalframe.queries import fixtures

    return fixtures


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_load().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_load().ORACLE)
