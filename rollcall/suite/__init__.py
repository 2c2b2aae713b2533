"""Every operator as a query over the driver tables, with the SQL that must agree.

``case`` registers a query under the operator's inventory name.  A query takes
:class:`rollcall.tables.Tables` and returns a DataFrame.  Results hold only
strings, whole numbers, booleans and rounded doubles, so that two engines can be
compared value by value.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from rollcall.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = (
    "queries",
    "joins",
    "aggregates",
    "expressions",
    "dates",
    "texts",
    "cleaning",
    "profiles",
    "identities",
    "timelines",
    "merges",
    "segments",
    "reports",
    "files",
    "streams",
    "chains",
)


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"rollcall.suite.{module}")


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, decimals as doubles, small integers as bigint."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def money(column: str):
    """An exact sum of amounts, as a double."""
    return F.sum(F.col(column).cast("decimal(19,2)")).cast("double")
