"""All bound queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.bindings import experiments, features, fits, joins, landing, posts, scores
from tidepanel.bindings.base import Tables

MODULES = [joins, features, posts, landing, scores, fits, experiments]


def _bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(Tables(spark, folder))


QUERIES = {name: _bind(query) for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
