"""Collects queries and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.proxy import SQL, Views, duckdb_ctes

QUERIES: dict[str, Callable] = {}
OF_VIEWS: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views; sql may use the stand-ins by name, and may start with further WITH entries."""

    def add(fn: Callable[[Views], DataFrame]):
        OF_VIEWS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = complete(sql)
        return fn

    return add


def complete(sql: str) -> str:
    used = duckdb_ctes(*(n for n in SQL if re.search(rf"\b{n}\b", sql)))
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        head, rest = "WITH RECURSIVE ", body[14:].strip()
    elif body.upper().startswith("WITH"):
        head, rest = "WITH ", body[4:].strip()
    else:
        return f"WITH {used} {body}" if used else body
    return head + (used + ", " if used else "") + rest
