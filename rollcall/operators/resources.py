"""Rows with their related rows: nested children and typed resources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rollcall.plans.query import with_limit
from rollcall.session import materialize

# More children than this per parent are spread over several rows.
CHUNK_ROWS = 200_000
PAGE = 100


def nest(
    children: DataFrame, key: str, name: str, chunk_rows: int = CHUNK_ROWS, wanted: DataFrame | None = None
) -> DataFrame:
    """(key, part, array of the other columns), sorted; for the keys in ``wanted`` if given.

    Only children of wanted keys are counted, and they are worked out once.

    Part 0 holds all children of an ordinary parent.  The children of a parent with
    more than ``chunk_rows`` never meet in one task: they are counted per distinct
    value (so copies shrink where they are read), and dealt by hash into parts of
    about that size.
    """
    if wanted is not None:
        children = children.join(wanted, key, "left_semi")
    children = materialize(children, "children")
    item = F.struct(*[F.col(f"`{c}`") for c in children.columns if c != key]).alias("_item")
    crowded = (
        children.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > chunk_rows)
        .select(key, F.ceil(F.col("_n") / chunk_rows).cast("int").alias("_parts"))
    )
    crowded = materialize(crowded, "crowded")
    few = children.join(crowded.select(key), key, "left_anti")
    ordinary = (
        few.select(key, item)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_item")).alias(name))
        .select(key, F.lit(0).alias("part"), name)
    )
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / chunk_rows).cast("int")))
    dealt = (
        children.join(crowded, key)
        .select(key, "_parts", item)
        .groupBy(key, "_parts", "_item")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_piece", piece)
        .withColumn("_copies", F.least(F.lit(chunk_rows), F.col("_copies") - F.col("_piece") * chunk_rows).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64(F.to_json("_item"), "_piece"), F.col("_parts")).cast("int"))
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_item", "_copies"))).alias("_items"))
        .select(
            key,
            "part",
            F.flatten(F.transform("_items", lambda i: F.array_repeat(i["_item"], i["_copies"]))).alias(name),
        )
    )
    return ordinary.unionByName(dealt)


def attach_children(
    parents: DataFrame,
    key: str,
    relationships: dict[str, dict[str, Any]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Parents with one array of ``{type, id}`` per relationship, empty if there are none.

    Children beyond ``chunk_rows`` of one parent follow in rows with ``part`` > 0, in
    which the parent's own columns other than the key are null.

    ``relationships`` maps a name to ``{"children", "foreign_key", "id", "type"}``.
    """
    wanted = parents.select(F.col(key).alias("_parent")).distinct()
    out = parents.withColumn("_parent", F.col(key)).withColumn("part", F.lit(0))
    for name, spec in relationships.items():
        links = spec["children"].select(
            F.col(spec["foreign_key"]).alias("_parent"),
            F.lit(spec.get("type", name)).alias("type"),
            F.col(spec["id"]).alias("id"),
        )
        nested = nest(links, "_parent", name, chunk_rows, wanted)
        out = out.join(nested, ["_parent", "part"], "full")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out.withColumn(key, F.col("_parent")).drop("_parent")


def resource_query(
    rows: DataFrame,
    type_name: str,
    key: str,
    include: dict[str, dict[str, Any]] | None = None,
    limit: int = PAGE,
    offset: int = 0,
    children_per_parent: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """A page of rows as ``{type, id, attributes, relationships}`` and what they include.

    A page, so the limit is the point: ``limit`` parents by id.  All their children come
    along; with ``children_per_parent`` only so many of each, by id, and the parent is marked as
    ``truncated``.  A parent with a great many children goes on in rows with ``part`` > 0.
    """
    page = materialize(with_limit(rows.orderBy(key), limit, offset), "page")
    attributes = F.struct(*[c for c in rows.columns if c != key])
    data = page.select(F.lit(type_name).alias("type"), F.col(key).alias("id"), attributes.alias("attributes"))
    if not include:
        return data, None
    included, relationships, cut = None, {}, None
    for name, spec in include.items():
        child, foreign, child_key = spec["children"], spec["foreign_key"], spec["id"]
        kind = spec.get("type", name)
        found = child.join(page.select(F.col(key).alias(foreign)), foreign, "left_semi")
        if children_per_parent is not None:
            by_id = Window.partitionBy(foreign).orderBy(child_key)
            found = found.withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= children_per_parent + 1)
            more = found.where(F.col("_rank") > children_per_parent).select(F.col(foreign).alias("id")).distinct()
            cut = more if cut is None else cut.unionByName(more).distinct()
            found = found.where(F.col("_rank") <= children_per_parent).drop("_rank")
        found = materialize(found, "included")
        relationships[name] = {"children": found, "foreign_key": foreign, "id": child_key, "type": kind}
        others = F.to_json(F.struct(*[c for c in child.columns if c != child_key]))
        rows_in = found.select(F.lit(kind).alias("type"), F.col(child_key).alias("id"), others.alias("attributes"))
        included = rows_in if included is None else included.unionByName(rows_in)
    data = attach_children(data, "id", relationships)
    if cut is not None:
        data = data.join(cut.withColumn("truncated", F.lit(True)), "id", "left").fillna(False, ["truncated"])
    data = data.withColumn("relationships", F.struct(*relationships)).drop(*relationships)
    return data, included
