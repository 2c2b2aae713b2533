"""Chains of transforms over one DataFrame, with bound lookups and side outputs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from rollcall.functions.dates import clean_date
from rollcall.functions.text import clean_columns
from rollcall.operators.clean import coerce, with_defaults
from rollcall.operators.identity import extract_identifiers
from rollcall.operators.merge import upsert
from rollcall.operators.timeline import append_email_domain, append_entry_id, append_entry_type_id, load_timeline
from rollcall.plans.query import keyed_lookup
from rollcall.sources.delimited import read_delimited, write_delimited
from rollcall.sources.jsonlines import read_jsonl, write_jsonl

# Transforms a chain may refer to by name.
KNOWN: dict[str, Callable] = {
    "clean_columns": clean_columns,
    "clean_date": clean_date,
    "coerce": coerce,
    "defaults": with_defaults,
    "extract_identifiers": extract_identifiers,
    "email_domain": append_email_domain,
    "entry_type_id": append_entry_type_id,
    "entry_id": append_entry_id,
}


@dataclass
class Outputs:
    """What a transform gives back when it gives more than rows."""

    rows: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    timeline: DataFrame | None = None


@dataclass
class Result:
    rows: DataFrame
    tables: dict[str, DataFrame]
    timeline: DataFrame | None
    planning_seconds: dict[str, float]


def bound(rows: DataFrame, binding: dict[str, Any], tables: dict[str, DataFrame]) -> DataFrame:
    """The lookup rows of a ``sql.query`` binding: those whose key occurs in ``rows``."""
    if binding.get("type", "sql.query") != "sql.query":
        raise ValueError(f"unknown binding {binding['type']}")
    return keyed_lookup(
        tables[binding["table"]],
        rows,
        binding["key"],
        binding.get("columns"),
        binding.get("conditions") or (),
        binding.get("foreign_key"),
    )


def run_chain(rows: DataFrame, steps: list[Any], tables: dict[str, DataFrame] | None = None) -> Result:
    """Apply ``steps`` in order.

    A step is a function, a known name, or ``{"transform", "options", "bindings"}``.
    Bound lookups arrive as keyword arguments.  A step returns the new rows, or
    :class:`Outputs` to also hand over rows for other tables or for the timeline.
    The chain is one Spark plan, whatever the step count.
    """
    side: dict[str, DataFrame] = {}
    timeline = None
    seconds: dict[str, float] = {}
    for i, step in enumerate(steps):
        spec = step if isinstance(step, dict) else {"transform": step}
        call = spec["transform"]
        if isinstance(call, str):
            if call not in KNOWN:
                raise ValueError(f"unknown transform {call}; known: {', '.join(KNOWN)}")
            call = KNOWN[call]
        lookups = {n: bound(rows, b, tables or {}) for n, b in (spec.get("bindings") or {}).items()}
        began = time.monotonic()
        got = call(rows, **(spec.get("options") or {}), **lookups)
        seconds[f"{i}:{getattr(call, '__name__', 'transform')}"] = time.monotonic() - began
        if isinstance(got, Outputs):
            rows = got.rows
            for name, frame in got.tables.items():
                side[name] = side[name].unionByName(frame, allowMissingColumns=True) if name in side else frame
            if got.timeline is not None:
                timeline = got.timeline if timeline is None else timeline.unionByName(got.timeline)
        else:
            rows = got
    return Result(rows, side, timeline, seconds)


def store(
    result: Result,
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]],
    timeline: DataFrame | None = None,
    order: list[str] = (),
):
    """Side outputs written over their tables, and timeline rows over the timeline (the last
    version of an entry by ``order``)."""
    out = dict(tables)
    for name, frame in result.tables.items():
        out[name] = upsert(tables[name], frame, keys[name]) if name in tables else frame
    if result.timeline is not None and timeline is not None:
        timeline = load_timeline(result.timeline, timeline, list(order))
    return out, timeline


def map_files(source: DataFrame, path: str, *transforms: Any, gzip: bool = False, jsonl: bool = False) -> DataFrame:
    """Row transforms from file to file: apply, write as CSV or JSON lines, read back."""
    rows = run_chain(source, list(transforms)).rows
    if jsonl:
        write_jsonl(rows, path, gzip)
        return read_jsonl(rows.sparkSession, path, rows.schema)
    write_delimited(rows, path, gzip)
    return read_delimited(rows.sparkSession, path, delimiter=",", relax=True)
