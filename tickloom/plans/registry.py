"""Named queries and the SQL text each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}
EXTRA_VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A further named subquery that oracle texts may read."""
    EXTRA_VIEWS[name] = sql


def _with_views(sql: str) -> str:
    """Prefix the text with the views it names, directly or through others."""
    known = VIEWS | EXTRA_VIEWS
    need: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name in need or name in open_ or not re.search(rf"\b{name}\b", text):
                continue
            open_.add(name)
            visit(known[name])
            need.append(name)

    visit(sql)
    if not need:
        return sql
    head = ",\n".join(f"{n} as materialized ({known[n]})" for n in need)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def query(rows: str, sql: str | None = None):
    """Register a query; ``rows`` lists the inventory rows it covers."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = fn.__name__

        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(Tables(spark, path))

        run.__name__ = name
        QUERIES[name] = run
        ROWS[name] = rows
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracle_texts() -> dict[str, str]:
    return {k: _with_views(v) for k, v in ORACLES.items()}


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def fine(col: str) -> Column:
    """To nine digits by plain arithmetic, which both engines do alike at halves."""
    return F.floor(F.col(col) * 1e9 + 0.5) / 1e9


def rounded(df: DataFrame, digits: int = 6, **other: int | None) -> DataFrame:
    """All double columns rounded, those in ``other`` to their own digits or, at None, not."""

    def column(name: str, kind: str) -> Column:
        d = other.get(name, digits)
        return F.col(name) if d is None or kind not in ("double", "float") else r(name, d).alias(name)

    return df.select(*[column(n, t) for n, t in df.dtypes])
