"""Segments: people by include and exclude rules, their members, and exports."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.functions.expressions import expression, tool_arithmetic
from rollcall.operators.merge import new_rows, new_rows_since
from rollcall.operators.resources import CHUNK_ROWS, nest
from rollcall.plans.query import run_query
from rollcall.session import materialize

Part = DataFrame | dict


def part_people(part: Part, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The distinct person_id of a part (a query object or a DataFrame), nulls left out.

    Copies are dropped in each task first, so a person with a third of the rows
    contributes one row per task to the shuffle.
    """
    rows = run_query(part, tables or {}) if isinstance(part, dict) else part
    if "person_id" not in rows.columns:
        raise ValueError("each part of a segment needs a person_id column")
    return rows.select("person_id").where("person_id is not null").distinct()


def segment_people(
    people: DataFrame,
    include: list[Part] = (),
    exclude: list[Part] = (),
    tables: dict[str, DataFrame] | None = None,
    key: str = "id",
) -> DataFrame:
    """person_id of the people in every include and in no exclude.

    A null person_id in an exclude excludes nobody.  (SQL's NOT IN would then
    return no one at all.)
    """
    chosen = people.select(F.col(key).alias("person_id"))
    for part in include:
        chosen = chosen.join(part_people(part, tables), "person_id", "left_semi")
    for part in exclude:
        chosen = chosen.join(part_people(part, tables), "person_id", "left_anti")
    return chosen


def segment_count(members: DataFrame) -> DataFrame:
    return members.agg(F.count("person_id").alias("people"))


def build_segment(segment_id: str, people: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(member table with this segment's people added once, its member count)."""
    rows = people.select(F.lit(segment_id).alias("segment_id"), "person_id")
    # Only this segment's members are read; partitioned by segment_id, only its folder.
    known = rows.limit(0) if members is None else members.where(F.col("segment_id") == segment_id)
    added = rows.distinct().join(known.select("person_id"), "person_id", "left_anti").select("segment_id", "person_id")
    table = added if members is None else members.unionByName(added, allowMissingColumns=True)
    counted = known.select("person_id").unionByName(added.select("person_id")).agg(
        F.lit(segment_id).alias("segment_id"), F.count("person_id").alias("people")
    )
    return table, counted


def segment_sample(members: DataFrame, people: DataFrame, key: str = "id", columns: list[str] = (), n: int = 10) -> DataFrame:
    """The first ``n`` members by id, with names."""
    return (
        people.join(members.select(F.col("person_id").alias(key)), key, "left_semi")
        .select(key, *columns)
        .orderBy(key)
        .limit(n)
    )


def segment_stats(members: DataFrame) -> DataFrame:
    """People per segment."""
    return members.groupBy("segment_id").agg(F.count("person_id").alias("people"))


# Rule operators.
RULES = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "beginsWith": lambda c, v: c.startswith(v),
    "endsWith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
    "null": lambda c, v: c.isNull(),
    "notNull": lambda c, v: c.isNotNull(),
    "in": lambda c, v: c.isin(*(v if isinstance(v, list) else str(v).split(","))),
}


def rules_to_predicate(rule: dict[str, Any]) -> Column:
    """Nested ``{combinator, rules, not}`` / ``{field, operator, value}`` to one condition."""
    if "rules" in rule:
        parts = [rules_to_predicate(r) for r in rule["rules"]]
        if not parts:
            return F.lit(True)
        either = rule.get("combinator", "and").lower() == "or"
        test = reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), parts)
    else:
        if rule["operator"] not in RULES:
            raise ValueError(f"unknown rule operator {rule['operator']}")
        test = RULES[rule["operator"]](F.col(rule["field"]), rule.get("value"))
    return ~test if rule.get("not") else test


@tool_arithmetic
def export_people(
    members: DataFrame,
    bindings: dict[str, dict | DataFrame],
    tables: dict[str, DataFrame] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per member with an array of related rows per binding (null when empty).

    A binding is a DataFrame with person_id, or ``{"table", "columns", "conditions"}``.
    Items are in order.  A member with more than ``chunk_rows`` related rows in a
    binding goes on in further rows, numbered by ``part``: nothing is dropped, and
    no row (or task) grows with the largest member.
    """
    wanted = materialize(members.select("person_id").distinct(), "members")
    out = wanted.withColumn("part", F.lit(0))
    for name, binding in bindings.items():
        rows = binding
        if isinstance(binding, dict):
            rows = tables[binding["table"]]
            for condition in binding.get("conditions") or ():
                rows = rows.where(expression(condition))
            rows = rows.select("person_id", *[c for c in binding.get("columns") or rows.columns if c != "person_id"])
        nested = nest(rows, "person_id", name, chunk_rows, wanted)
        out = out.join(nested, ["person_id", "part"], "full")
    return out


def write_export(export: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines; empty bindings are absent from the line.  Only a line that goes on with a
    person (``part`` 1 and up) carries its part."""
    if "part" in export.columns:
        export = export.withColumn("part", F.when(F.col("part") > 0, F.col("part")))
    export.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def export_delta(export: DataFrame, previous: DataFrame, by_person: bool = False) -> DataFrame:
    """Rows that differ from an earlier export (or, by person, all rows of people not in it)."""
    if by_person:
        return export.join(previous.select("person_id").distinct(), "person_id", "left_anti")
    return new_rows(export, previous)


def export_delta_since(export: DataFrame, path: str) -> DataFrame:
    """Rows of an export that no earlier export remembered at ``path`` had (``remember_rows``)."""
    return new_rows_since(export, path)
