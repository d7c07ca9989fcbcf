"""Registered queries: each operator over the driver's tables, with SQL where SQL can say it.

Every module has QUERIES: name -> (function of Views, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import Views
from . import actions, algebra, alignment, export, history, log, lookup, more, scalars, sources, spans, text

MODULES = (algebra, log, history, actions, scalars, alignment, lookup, export, text, spans, sources, more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(function) for module in MODULES for name, (function, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}


def _bound(function: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: function(Views(spark, folder))
