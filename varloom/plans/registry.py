"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def oracles() -> dict[str, str]:
    """The SQL of every query with the views it needs."""
    return {name: _with_views(sql) for name, sql in ORACLES.items()}


def _with_views(body: str) -> str:
    """Prefix the views that ``body`` uses, directly or through other views."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                if VIEWS[name] is not text:
                    visit(VIEWS[name])
                    if name not in ordered:
                        ordered.append(name)

    visit(body)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
