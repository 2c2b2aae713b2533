"""Query objects: a dict that names columns, conditions, joins, groups and order.

``run_query`` turns one into a chain of DataFrame calls; Catalyst does the rest.

    {"table": "orders",
     "columns": ["o_custkey", {"eql": "sum(o_totalprice)", "name": "spent"}],
     "joins": [{"table": "customer", "join_eql": "orders.o_custkey = customer.c_custkey"}],
     "conditions": [{"eql": "customer.c_acctbal > 0"}],
     "groupBy": [{"column": "o_custkey"}],
     "having": [{"eql": "count(*) > 3"}],
     "orderBy": [{"eql": "spent", "orderByDirection": "desc"}],
     "limit": 10}
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions.dates import BUCKETS
from rollcall.functions.expressions import expression, tool_arithmetic
from rollcall.plans.pages import Pages
from rollcall.plans.ranges import range_join, range_totals

NAME = re.compile(r"[A-Za-z0-9_]+")

TOTAL = re.compile(r"\b(count|sum|min|max)\(\s*(\*|[\w.]+)\s*\)", re.I)

# Aggregate names of a query object.
AGGREGATES = {
    "NONE": lambda c: c,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "SUM": F.sum,
    "AVERAGE": F.avg,
    "MAX": F.max,
    "MIN": F.min,
}

# Condition names of a query object.
CONDITIONS = {
    "EQUALS": lambda a, b: a == b,
    "NOT_EQUALS": lambda a, b: a != b,
    "LESS_THAN": lambda a, b: a < b,
    "LESS_THAN_OR_EQUAL": lambda a, b: a <= b,
    "GREATER_THAN": lambda a, b: a > b,
    "GREATER_THAN_OR_EQUAL": lambda a, b: a >= b,
    # The searched text is taken literally: % and _ are ordinary characters.
    "CONTAINS": lambda a, b: a.contains(b),
    "DOES_NOT_CONTAIN": lambda a, b: ~a.contains(b),
    "IS_NULL": lambda a: a.isNull(),
    "IS_NOT_NULL": lambda a: a.isNotNull(),
}

# Join types.
JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


# An offset from here on is read by pages (a query with one runs when it is built).
DEEP = 10_000


class Scope:
    """The columns a query object may name, by table alias."""

    def __init__(self, base: str, columns: dict[str, list[str]]):
        self.base = base
        self.columns = columns

    def column(self, item: Any, missing_ok: bool = False) -> Column | None:
        """The column an item stands for, without its alias."""
        if isinstance(item, str):
            item = {"column": item}
        if item.get("eql"):
            return expression(item["eql"])
        name, table = item.get("column"), item.get("table") or self.base
        if not name:
            raise ValueError(f"neither column nor eql in {item}")
        if table not in self.columns:
            raise ValueError(f"no such table: {table}")
        if name not in self.columns[table]:
            if missing_ok:
                return None
            raise ValueError(f"no such column: {name} in {table}")
        bucket = BUCKETS[item.get("function") or "NONE"]
        return AGGREGATES[item.get("aggregate") or "NONE"](bucket(F.col(f"{table}.{name}")))

    def selected(self, items: list[Any]) -> list[tuple[str, Column]]:
        """(name, column) pairs; plain columns the table does not have are left out."""
        out = []
        for item in items:
            entry = {"column": item} if isinstance(item, str) else item
            if entry.get("column") == "*":
                table = entry.get("table") or self.base
                out += [(c, F.col(f"{table}.{c}")) for c in self.columns[table]]
                continue
            if entry.get("eql") and not entry.get("name"):
                raise ValueError(f"a name is required with eql: {entry}")
            found = self.column(entry, missing_ok=True)
            if found is not None:
                out.append((entry.get("name") or _default_name(entry), found))
        return out

    def condition(self, item: Any) -> Column:
        if isinstance(item, Column):
            return item
        if isinstance(item, str):
            item = {"eql": item}
        if item.get("eql"):
            return expression(item["eql"])
        kind = item.get("type")
        if kind not in CONDITIONS:
            raise ValueError(f"unknown condition {kind}; known: {', '.join(CONDITIONS)}")
        return CONDITIONS[kind](*[self._operand(v) for v in item.get("values", [])])

    def _operand(self, value: dict) -> Column:
        if value.get("value") is not None:
            return F.lit(value["value"]["value"])
        return self.column(value["ref"])


def _default_name(entry: dict) -> str:
    name = entry["column"]
    for key in ("function", "aggregate"):
        if entry.get(key) and entry[key] != "NONE":
            name = f"{entry[key].lower()}_{name}"
    return name



def _whole(value: Any, what: str) -> int:
    if value in (None, "", 0):
        return 0
    if isinstance(value, bool) or not re.fullmatch(r"\d+", str(value)):
        raise ValueError(f"invalid {what}: {value}")
    return int(value)


def with_limit(df: DataFrame, limit: Any = None, offset: Any = None) -> DataFrame:
    """``offset`` applies only together with a limit; 0 or nothing is unlimited."""
    count, skip = _whole(limit, "limit"), _whole(offset, "offset")
    if not count:
        return df
    return (df.offset(skip) if skip else df).limit(count)


def override_limit(spec: dict, limit: Any = None, offset: Any = None) -> dict:
    """The same query object with another limit and offset."""
    return {**spec, "limit": limit, "offset": offset}


def _direction(item: Any) -> str:
    way = (item.get("orderByDirection") or "asc").lower() if isinstance(item, dict) else "asc"
    if way not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {way}")
    return way


def _base(spec: dict, tables: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    if spec.get("subquery"):
        inner = spec["subquery"]
        alias = inner.get("alias") or spec.get("table")
        if not alias:
            raise ValueError("a subquery needs a table name")
        return alias, run_query(inner, tables)
    table = spec.get("table")
    if not table:
        raise ValueError("table required")
    if table == "dual":
        return table, SparkSession.active().range(1).select()
    if table not in tables:
        raise ValueError(f"no such table: {table}")
    return table, tables[table]


def _joined(df: DataFrame, columns: dict[str, list[str]], joins: list, tables: dict[str, DataFrame]) -> DataFrame:
    for join in joins:
        if not isinstance(join, dict) or not join.get("table") or not (join.get("join_eql") or join.get("range")):
            raise ValueError(f"a join needs table and join_eql or range: {join}")
        kind = join.get("type", "inner")
        if kind not in JOINS:
            raise ValueError(f"join type must be one of {', '.join(JOINS)}, not {kind}")
        alias = join.get("alias") or join["table"]
        other = tables[join["table"]]
        columns[alias] = other.columns
        if join.get("range"):
            if kind != "inner":
                raise ValueError(f"a range join in a query is inner, not {kind}")
            value, low, high = (expression(join["range"][k]) for k in ("value", "low", "high"))
            also = expression(join["join_eql"]) if join.get("join_eql") else None
            df = range_join(df, other.alias(alias), value, low, high, also)
            continue
        df = df.join(other.alias(alias), expression(join["join_eql"]), JOINS[kind])
    return df


def _as_totals(spec: dict, tables: dict[str, DataFrame]) -> DataFrame | None:
    """A query that only counts, adds up or takes the least or greatest of a table's columns by columns of
    one that it meets in ranges, without making the pairs; None if it asks for anything else."""
    joins, groups, items = (spec.get(k) or [] for k in ("joins", "groupBy", "columns"))
    if len(joins) != 1 or not groups or not items or any(spec.get(k) for k in ("conditions", "having", "orderBy", "fields", "subquery")):
        return None
    join, base = joins[0], spec.get("table")
    if not isinstance(join, dict) or not join.get("range") or join.get("join_eql") or join.get("type", "inner") != "inner":
        return None
    alias, other = join.get("alias") or join.get("table"), tables.get(join.get("table"))
    if other is None or base not in tables or alias == base:
        return None
    plain = lambda x: isinstance(x, dict) and x.get("table") == alias and set(x) <= {"table", "column", "name"} and x.get("column") in other.columns
    if not all(plain(g) for g in groups):
        return None
    left = tables[base].alias(base)
    kinds = {f.name: f.dataType.typeName() for f in left.schema.fields}
    totals: dict[str, tuple[str, Column]] = {}

    def part(found: re.Match) -> str:
        kind, name = found[1].lower(), found[2].removeprefix(f"{base}.")
        known = name == "*" if kind == "count" and name == "*" else name in kinds and (name != found[2] or name not in other.columns)
        if not known or (kind == "sum" and kinds[name] not in ("double", "integer", "long", "short")):
            return found[0]
        totals[f"_total{len(totals)}"] = kind, F.lit(1) if name == "*" else F.col(f"{base}.{name}")
        return f"{'sum' if kind == 'count' else kind}(_total{len(totals) - 1})"

    out = []
    for item in items:
        if plain(item):
            if not any(item["column"] == g["column"] for g in groups):
                return None
            out.append(item)
            continue
        if not isinstance(item, dict) or set(item) != {"eql", "name"}:
            return None
        eql = TOTAL.sub(part, item["eql"])
        if not re.fullmatch(r"(?:sum|min|max)\(_total\d+\)|cast\((?:sum|min|max)\(_total\d+\) as \w+\)", eql.strip(), re.I):
            return None
        out.append({**item, "eql": eql})
    if not totals:
        return None
    value, low, high = (expression(join["range"][k]) for k in ("value", "low", "high"))
    rows = range_totals(left, other.alias(alias), value, low, high, totals)
    return run_query({**spec, "table": alias, "joins": None, "columns": out}, {alias: rows})


@tool_arithmetic
def run_query(spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    items = spec.get("columns") or spec.get("fields")
    if not items:
        raise ValueError("no columns; at least specify columns=['*']")
    totals = _as_totals(spec, tables)
    if totals is not None:
        return totals
    base, df = _base(spec, tables)
    columns = {base: df.columns}
    df = _joined(df.alias(base), columns, spec.get("joins") or [], tables)
    scope = Scope(base, columns)
    for condition in spec.get("conditions") or []:
        df = df.where(scope.condition(condition))

    distinct = isinstance(items[0], dict) and re.match(r"\s*distinct\s", items[0].get("eql") or "", re.I)
    if distinct:
        items = [{**items[0], "eql": re.sub(r"^\s*distinct\s+", "", items[0]["eql"], flags=re.I)}, *items[1:]]
    chosen = scope.selected(items)
    outputs = [name for name, _ in chosen]
    computed = [column.alias(name) for name, column in chosen]

    # Order and having may name outputs or compute something of their own; what
    # they compute rides along as extra columns and is dropped at the end.
    extra: list[Column] = []

    def carried(column: Column, prefix: str) -> Column:
        name = f"_{prefix}{len(extra)}"
        extra.append(column.alias(name))
        return F.col(name)

    order = []
    for item in [spec["orderBy"]] if isinstance(spec.get("orderBy"), (str, dict)) else spec.get("orderBy") or []:
        text = item if isinstance(item, str) else item.get("eql") or ""
        if text.strip() in outputs:
            key = F.col(f"`{text.strip()}`")
        else:
            key = carried(scope.column(item), "order")
        order.append(key.desc() if _direction(item) == "desc" else key.asc())
    having = [carried(scope.condition(c), "having") for c in spec.get("having") or []]

    groups = spec.get("groupBy") or []
    if groups:
        keys = [scope.column(g) for g in groups]
        df = df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*computed, *extra)
    else:
        df = df.select(*computed, *extra)
    for test in having:
        df = df.where(test)
    if distinct:
        df = df.distinct()
    limit, offset = spec.get("limit"), spec.get("offset")
    if order and _whole(limit, "limit") and _whole(offset, "offset") >= DEEP:
        # The same rows, read from where they lie instead of gathered from the top.
        df, limit, offset = Pages(df, order).page(_whole(offset, "offset"), _whole(limit, "limit")), None, None
    elif order:
        df = df.orderBy(*order)
    if df.columns != outputs:
        df = df.select(*[f"`{name}`" for name in outputs])
    return with_limit(df, limit, offset)


@tool_arithmetic
def keyed_lookup(
    table: DataFrame,
    keys: DataFrame,
    key: str,
    columns: list[str] | None = None,
    conditions: list[str] = (),
    foreign_key: str | None = None,
) -> DataFrame:
    """Rows of ``table`` whose ``foreign_key`` is among ``keys[key]``.

    Nothing is run here.  Spark sees at run time how many distinct keys there are,
    and broadcasts them only if they are few.
    """
    wanted = keys.where(F.col(key).isNotNull()).select(F.col(key).alias(foreign_key or key)).distinct()
    found = table.join(wanted, foreign_key or key, "left_semi")
    for condition in conditions:
        found = found.where(expression(condition))
    return found.select(*columns) if columns else found.select(*table.columns)


def fetch_by_id(table: DataFrame, key: str, value: int | str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one id, or all rows by id; the first ``limit`` of them if it is given."""
    found = table.orderBy(key) if value is None else table.where(F.col(key) == F.lit(value))
    return with_limit(found, limit)


def read_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
