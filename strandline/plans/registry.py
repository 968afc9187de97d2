"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """Name a piece of SQL that twins may build on."""
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """Put the named pieces, and what they need, in front of a statement."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    pieces = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    if not pieces:
        return body
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {pieces},\n{stripped[5:]}"
    return f"WITH {pieces}\n{body}"


def query(name: str, twin: str | None = None):
    """Register a query, with the SQL twin when there is one."""

    def register(fn):
        QUERIES[name] = fn
        if twin is not None:
            ORACLE[name] = twin
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    chosen = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: rnd(F.col(c), digits) for c in chosen})


def rnd(c: Column, digits: int = 6) -> Column:
    # adding 0.0 turns a negative zero into zero
    return F.round(c, digits) + F.lit(0.0)
