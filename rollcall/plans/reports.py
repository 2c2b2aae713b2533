"""Reports: several named components, each one query over a data source."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame

from rollcall.functions.dates import bucket_for_span, relative_bound
from rollcall.functions.expressions import expression
from rollcall.plans.query import run_query

DATE_NAME = "dimension_name"


def _listed(value: Any) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _named(items: list, start: int = 0) -> list[dict]:
    out = []
    for i, item in enumerate(items, start):
        entry = {"column": item, "name": item} if isinstance(item, str) else dict(item)
        entry.setdefault("name", f"col{i}")
        out.append(entry)
    return out


def date_conditions(column: str | None, start=None, end=None, at: Column | None = None) -> list[Column]:
    """``start <= column < end`` for the bounds that are given."""
    if not column:
        return []
    low, high = relative_bound(start, at), relative_bound(end, at)
    out = []
    if low is not None:
        out.append(expression(column) >= low)
    if high is not None:
        out.append(expression(column) < high)
    return out


def span_days(overrides: dict[str, Any]) -> int:
    """How many days are asked for: given, or between two ISO bounds."""
    if overrides.get("days"):
        return int(overrides["days"])
    try:
        start = datetime.fromisoformat(str(overrides["start"]))
        end = datetime.fromisoformat(str(overrides["end"])) if overrides.get("end") else datetime.now(timezone.utc)
        return (end.replace(tzinfo=None) - start.replace(tzinfo=None)).days
    except (KeyError, ValueError):
        return 0


def component_query(component: dict, source: dict, overrides: dict, at: Column | None = None) -> dict:
    """The query object of one component.

    Dimensions (a date, one, or several), then breakdowns, then metrics; grouped by
    dimensions and breakdowns.  Without either it is a scorecard: one row.  All rows are
    returned unless the overrides set a limit.
    """
    if component.get("query"):
        return component["query"]
    groups: list = []
    if component.get("isDate"):
        bucket = bucket_for_span(span_days(overrides))
        groups.append({"name": DATE_NAME, "eql": f"{bucket}({component['dimension']['eql']})"})
    else:
        groups += _listed(component.get("dimension")) or _listed(component.get("dimensions"))
    groups += _listed(component.get("breakdown"))
    groups = _named(groups)
    metrics = _named(_listed(component.get("metric")) + _listed(component.get("metrics")), len(groups))

    conditions = (
        _listed(component.get("conditions"))
        + _listed(source.get("queryStringConditions"))
        + _listed(source.get("conditions"))
        + date_conditions(source.get("date_column"), overrides.get("start"), overrides.get("end"), at)
    )
    query = {
        "table": component.get("table") or source.get("table"),
        "joins": source.get("joins") or [],
        "columns": groups + metrics,
        "conditions": conditions,
        "groupBy": groups,
        "orderBy": component.get("orderBy") or [],
        "limit": overrides.get("limit"),
        "offset": overrides.get("offset") or component.get("offset") or 0,
    }
    inner = source.get("subquery")
    if inner:
        inner = dict(inner)
        # The window goes inside, before the inner aggregation.
        inner["conditions"] = _listed(inner.get("conditions")) + date_conditions(
            inner.pop("date_column", None), overrides.get("start"), overrides.get("end"), at
        )
        query["subquery"] = inner
    return query


def run_report(
    report: dict, tables: dict[str, DataFrame], overrides: dict | None = None, at: Column | None = None
) -> dict[str, DataFrame | str]:
    """Every component as a DataFrame, by name; text components pass through."""
    overrides = overrides or {}
    out: dict[str, DataFrame | str] = {}
    for name, component in report["components"].items():
        if not isinstance(component, dict):
            out[name] = component
            continue
        source_name = component.get("data_source") or "default"
        if source_name not in report["data_sources"]:
            raise ValueError(f"no data source {source_name}")
        out[name] = run_query(component_query(component, report["data_sources"][source_name], overrides, at), tables)
    return out
