"""Registry of queries and of the DuckDB text each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forcemap.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the view definitions it mentions, directly or through another view."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, sql in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(sql)
    ctes = [f"{name} AS ({sql.strip()})" for name, sql in VIEW_SQL.items() if name in needed]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``, with its SQL twin if there is one."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
