"""All relational queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asofkit.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its DuckDB SQL."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A projection that both engines read, over the tables of ``sf_dir``."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b{t}\b(?!\.)", f"{{{t}}}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def _load_all() -> None:
    from . import domain, entities, fact_tables, point_in_time, quality, scoring, statistics  # noqa: F401


_load_all()
