"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return fn

    return register


def with_roles(sql: str) -> str:
    """Prefix a check statement with the role tables (``r_…``) it mentions."""
    from toolmill.plans.roles import ROLE_SQL

    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"\br_\w+", text):
            if word in ROLE_SQL and word not in needed:
                needed.add(word)
                visit(ROLE_SQL[word])

    visit(sql)
    parts = [f"{name} AS ({ROLE_SQL[name]})" for name in ROLE_SQL if name in needed]
    body = sql.strip()
    if not parts:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ", ".join(parts) + "," + body[14:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
