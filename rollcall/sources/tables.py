"""Catalog tables and copies between stores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions.dates import date_window
from rollcall.functions.text import clean_columns
from rollcall.operators.clean import whole_cast
from rollcall.operators.merge import keep_latest, read_files
from rollcall.operators.profile import infer_types
from rollcall.session import materialize

# Columns that date a row of a copied table, the most telling first.
SYNC_DATE_FIELDS = ("modified_at", "last_modified", "created_at")

# Inferred column types and the table type of each.
TABLE_TYPES = {
    "int": "bigint",
    "double": "double",
    "decimal": "decimal(19,4)",
    "date": "date",
    "datetime": "timestamp",
    "uuid": "string",
    "string": "string",
}


def typed(df: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to what all their values are."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df
    kinds = {r["name"]: TABLE_TYPES[r["type"]] for r in infer_types(df.select(*text), hints).collect()}
    return df.select(*[whole_cast(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def create_and_load(
    df: DataFrame,
    table: str,
    primary: str | None = None,
    ignore: list[str] = (),
    path: str | None = None,
    hints: dict[str, str] | None = None,
) -> DataFrame:
    """A new table from a stream of rows: cleaned names, inferred types, loaded.

    With ``primary`` the last row per key stays (in column order)."""
    rows = typed(clean_columns(df).drop(*ignore), hints)
    if primary:
        rows = keep_latest(rows, [primary], [])
    writer = rows.write.mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def load_table(df: DataFrame, table: str) -> DataFrame:
    """Append by column name; columns the table lacks are left out, columns ``df``
    lacks are null."""
    spark = df.sparkSession
    fields = spark.table(table).schema.fields
    df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    ).write.insertInto(table)
    return spark.table(table)


def insert_from_query(spark: SparkSession, table: str, sql: str) -> DataFrame:
    """INSERT INTO the columns the query yields."""
    names = ", ".join(f"`{c}`" for c in spark.sql(sql).columns)
    spark.sql(f"INSERT INTO {table} ({names}) {sql}")
    return spark.table(table)


def head(df: DataFrame, n: int = 3) -> DataFrame:
    return df.limit(n)


def sample(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def _window_of(source: DataFrame, start, end, date_field: str | None, at: Column | None) -> DataFrame:
    if start is None and end is None:
        return source
    field = date_field or next((f for f in SYNC_DATE_FIELDS if f in source.columns), None)
    if field is None:
        raise ValueError(f"no date column among {', '.join(source.columns)}")
    return date_window(source, field, start, end, at)


def _stored_types(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``rows`` in the columns and types of what is stored.  A value a stored type cannot hold
    fails the copy instead of being lost."""
    if stored is None:
        return typed(rows)
    return rows.select(*[whole_cast(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in stored.schema.fields])


def sync_table(
    source: DataFrame,
    path: str,
    start=None,
    end=None,
    date_field: str | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Copy a table, or its rows with ``start <= date_field < end``, to ``path``.

    Over JDBC the date filter becomes part of the source's own query.  The copy is
    appended: rows that were copied before are told apart on reading, by
    :func:`current`, so a repeated or overlapping copy loses and doubles nothing.
    Returns the copied rows.  A copy that is brought up to date again and again is
    better kept by :func:`sync_compacted`.
    """
    spark = source.sparkSession
    rows = _window_of(source, start, end, date_field, at)
    rows = _stored_types(rows, read_files(spark, path))
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


# --- copies that stay as large as their source -----------------------------------------

BUCKETS = 64
# A bucket is merged when its changes are more than this share of its rows.
MOST_CHANGED = 0.5


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.concat(F.lit("b-"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def _layers(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(base, changes not merged into it yet); a change of a later copy has a larger ``seq``."""
    base, changes = read_files(spark, f"{path}/base"), read_files(spark, f"{path}/changes")
    if changes is None:
        return base, None
    merged = read_files(spark, f"{path}/merged")
    changes = changes.withColumn("seq", F.substring("seq", 3, 20).cast("bigint"))
    if merged is not None:
        # One row per bucket: changes up to its number are part of the base, their folders are not opened.
        done = merged.groupBy(F.col("bucket").alias("_bucket")).agg(F.max("upto").alias("_upto"))
        changes = changes.join(F.broadcast(done), F.col("bucket") == F.col("_bucket"), "left")
        changes = changes.where(F.col("_upto").isNull() | (F.col("seq") > F.col("_upto"))).drop("_bucket", "_upto")
    return base, changes


def current_compacted(spark: SparkSession, path: str, keys: list[str], order: list[str] = ()) -> DataFrame:
    """The last version of each row of a table kept by :func:`sync_compacted`: the base, with
    the changes since its last merge (at most ``MOST_CHANGED`` of it) in place of its rows."""
    base, changes = _layers(spark, path)
    if changes is None:
        return base.drop("bucket")
    latest = keep_latest(changes, keys, [*order, "seq"]).drop("seq")
    if base is None:
        return latest.drop("bucket")
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest).drop("bucket")


def sync_compacted(
    source: DataFrame,
    path: str,
    keys: list[str],
    order: list[str] = (),
    start=None,
    end=None,
    date_field: str | None = None,
    at: Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Bring the copy at ``path`` up to date with ``source``, or with its rows in a date window.

    Rows are matched by ``keys``; of two versions the one that is last by ``order`` counts, of
    equals the one copied last.  What differs from the copy is added as changes, in folders by
    a hash of the key; a bucket whose changes have outgrown it is merged into its base, by
    itself.  So reading costs about as much after many copies as after the first, and copying
    the same rows again writes nothing.  Rows are never deleted.  Base folders are replaced
    before the merge is noted, so a merge that failed is simply done again.  Null keys do not match, so they are refused.  Returns the
    current rows.
    """
    spark = source.sparkSession
    rows = _window_of(source, start, end, date_field, at)
    base, changes = _layers(spark, path)
    stored = None if base is None and changes is None else current_compacted(spark, path, keys, order)
    rows = _stored_types(rows, stored)
    checked = F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True), F.raise_error(F.lit("a row without a key"))).otherwise(F.lit(True))
    rows = keep_latest(rows.where(checked.cast("boolean")), keys, list(order))
    if stored is not None:
        # Only what beats the row on file, or differs from it, is new.
        others = [c for c in rows.columns if c not in keys]
        old = stored.select(*keys, F.struct(*order).alias("_rank") if order else F.lit(None).alias("_rank"), F.xxhash64(*others).alias("_content"), F.lit(True).alias("_old"))
        rank = F.struct(*order) >= F.col("_rank") if order else F.lit(True)
        newer = F.col("_old").isNull() | (rank & (F.xxhash64(*[rows[c] for c in others]) != F.col("_content")))
        rows = rows.join(old, keys, "left").where(newer).select(*rows.columns)
    fresh = materialize(rows.withColumn("bucket", _bucket(keys, buckets)), "changes")
    if fresh.isEmpty():
        return current_compacted(spark, path, keys, order) if stored is not None else fresh.drop("bucket")
    if stored is None:
        fresh.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base")
        return current_compacted(spark, path, keys, order)
    every = read_files(spark, f"{path}/changes")
    last = 0 if every is None else every.agg(F.max(F.substring("seq", 3, 20).cast("bigint"))).first()[0] or 0
    added = fresh.withColumn("seq", F.lit(f"s-{last + 1}")).hint("rebalance", "bucket")
    added.write.mode("append").partitionBy("bucket", "seq").parquet(f"{path}/changes")
    _merge_crowded(spark, path, keys, order)
    return current_compacted(spark, path, keys, order)


def _merge_crowded(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> None:
    base, changes = _layers(spark, path)
    one = F.count(F.lit(1))
    changed = changes.groupBy("bucket").agg(one.alias("changed"), F.max("seq").alias("upto"))
    sizes = base.groupBy("bucket").agg(one.alias("size"))
    crowded = changed.join(sizes, "bucket", "left").where(F.col("changed") > F.coalesce("size", F.lit(0)) * MOST_CHANGED)
    crowded = materialize(crowded.select("bucket", "upto"), "crowded")  # at most a row per bucket
    names = crowded.where("bucket >= 'b-'").select("bucket")
    latest = keep_latest(changes.join(names, "bucket", "left_semi"), keys, [*order, "seq"]).drop("seq")
    kept = base.join(names, "bucket", "left_semi").join(latest.select(*keys), keys, "left_anti")
    whole = materialize(kept.unionByName(latest), "merged-buckets")
    if whole.isEmpty():
        return
    options = {"partitionOverwriteMode": "dynamic"}
    whole.hint("rebalance", "bucket").write.mode("overwrite").options(**options).partitionBy("bucket").parquet(f"{path}/base")
    crowded.write.mode("overwrite").options(**options).partitionBy("bucket").parquet(f"{path}/merged")


def current(spark: SparkSession, path: str, keys: list[str], order: list[str] = ()) -> DataFrame:
    """The last version of each row of a synced table."""
    return keep_latest(spark.read.parquet(path), keys, list(order))


def choose_tables(
    names: list[str],
    include: list[str] | None = None,
    patterns: list[str] | None = None,
    exclude: list[str] = (),
    temporary: bool = False,
) -> list[str]:
    """Tables by list or by patterns (any may match, case-insensitively), less the excluded."""
    out = list(include) if include else list(names)
    if patterns:
        out = [n for n in out if any(re.search(p, n, re.I) for p in patterns)]
    if not temporary:
        out = [n for n in out if not re.match(r"te?mp_", n)]
    return [n for n in out if n not in exclude]


def sync_tables(
    sources: dict[str, DataFrame],
    folder: str,
    include: list[str] | None = None,
    patterns: list[str] | None = None,
    exclude: list[str] = (),
    start=None,
    end=None,
    temporary: bool = False,
) -> dict[str, DataFrame]:
    """:func:`sync_table` for each chosen table, below ``folder``."""
    chosen = choose_tables(list(sources), include, patterns, exclude, temporary)
    return {name: sync_table(sources[name], f"{folder}/{name}", start, end) for name in chosen}
