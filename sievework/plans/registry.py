"""Registry of the queries the entry module exposes, each with its SQL counterpart if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SPACE_RE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def norm_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x},''))),'[-_/]',' ','g'),"
        f"'{SPACE_RE}+',' ','g'))"
    )


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(literal(x) for x in v) + "]"
    return str(v)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE holding a literal rule table."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"
