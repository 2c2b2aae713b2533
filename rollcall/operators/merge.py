"""Upserts, inserts and de-duplication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rollcall.plans.skew import keep_latest
from rollcall.session import materialize

__all__ = [
    "upsert", "upsert_files", "read_range", "insert_ignore", "upsert_many", "keep_latest", "new_rows", "new_rows_since", "remember_rows", "row_identity", "ensure_view",
]

# Filled in by the store, never taken from incoming rows.
STORE_COLUMNS = ("created_at", "modified_at")


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    order: list[Column | str] = (),
    few: bool = False,
) -> DataFrame:
    """``target`` with ``incoming`` written over it.

    The last incoming row per key (by ``order``) wins.  Columns it does not
    supply keep their old value; columns ``target`` does not have are ignored.

    Both sides are matched in one full outer join; keys are unique on both, so no
    key can overload a task.  With ``few`` (incoming rows Spark can broadcast) the
    target is streamed past them instead and never shuffled.
    """
    supplied = [c for c in target.columns if c in incoming.columns and c not in STORE_COLUMNS]
    ranked_by = [c for c in order if isinstance(c, str) and c not in supplied]
    latest = keep_latest(incoming.select(*supplied, *ranked_by), keys, list(order)).select(*supplied)
    values = [c for c in supplied if c not in keys]
    fresh = latest.select(*keys, F.struct(F.lit(True).alias("_present"), *values).alias("_new"))
    kinds = {f.name: f.dataType for f in target.schema.fields}
    given = F.col("_new").isNotNull()

    def column(name: str, is_new: Column | None) -> Column:
        old = F.col(name)
        if name in keys:
            return old
        if name in values:
            return F.when(given, F.col(f"_new.{name}").cast(kinds[name])).otherwise(old).alias(name)
        if name == "modified_at" or (name == "created_at" and is_new is not None):
            stamped = given if name == "modified_at" else given & is_new
            return F.when(stamped, F.current_timestamp().cast(kinds[name])).otherwise(old).alias(name)
        return old

    if not few:
        marked = target.withColumn("_old", F.lit(True))
        joined = marked.join(fresh, keys, "full")
        return joined.select(*[column(c, F.col("_old").isNull()) for c in target.columns])

    kept = target.join(fresh, keys, "left").select(*[column(c, None) for c in target.columns])
    known = target.select(*keys).join(latest.select(*keys), keys, "left_semi")
    missing = [c for c in target.columns if c not in supplied]
    added = fresh.join(known, keys, "left_anti").withColumns({c: F.lit(None).cast(kinds[c]) for c in [*values, *missing]})
    return kept.unionByName(added.select(*[column(c, F.lit(True)) for c in target.columns]))


def read_files(spark, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


# Beside the folders of a stored table: the first and last time each of them holds.
BOUNDS = "_bounds"


def _within(stored: DataFrame, names: DataFrame) -> DataFrame:
    """``stored`` in the folders ``names`` (part, selected from a table of known size): Spark
    reads the names first and opens only those folders, however many they are."""
    return stored.join(names.select("part"), "part", "left_semi").select(*stored.columns)


def folder_bounds(spark, path: str) -> DataFrame | None:
    """(part, low, high) of the table at ``path``; None if it keeps no bounds."""
    return read_files(spark, f"{path}/{BOUNDS}")


def _widen_bounds(path: str, stored: DataFrame | None, fresh: DataFrame, bounds: str) -> None:
    """Bounds of the folders in ``fresh`` (part, low, high), never narrower than before.

    They are written before the rows, so a failure in between leaves bounds that are too
    wide, never too narrow.  A table that has no bounds yet gets them for all its folders."""
    known = folder_bounds(fresh.sparkSession, path)
    if known is None and stored is not None:
        known = stored.groupBy("part").agg(F.min(bounds).alias("low"), F.max(bounds).alias("high"))
        wide = known.unionByName(fresh)
    elif known is not None:
        wide = _within(known, fresh).unionByName(fresh)
    else:
        wide = fresh
    wide = wide.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ready = materialize(wide, "bounds")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{BOUNDS}")


def read_range(spark, path: str, column: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Rows of the table stored at ``path`` with ``low <= column < high``.

    Only folders whose bounds on ``column`` meet the range are opened, whatever decided the
    folder of a row; without bounds on file the whole table is scanned."""
    rows = spark.read.parquet(path)
    known = folder_bounds(spark, path)
    if low is not None:
        rows = rows.where(F.col(column) >= low)
    if high is not None:
        rows = rows.where(F.col(column) < high)
    if known is None or (low is None and high is None):
        return rows
    if low is not None:
        known = known.where(F.col("high") >= low)
    if high is not None:
        known = known.where(F.col("low") < high)
    return _within(rows, known)


def upsert_files(
    path: str,
    incoming: DataFrame,
    keys: list[str],
    partition: Column | None = None,
    order: list[Column | str] = (),
    bounds: str | None = None,
) -> None:
    """:func:`upsert` on a table stored as Parquet under ``path`` (made if missing).

    ``partition`` is computed from the keys.  Only the partitions the incoming rows
    fall in are read and replaced; the rest of the table is not touched.  The incoming
    rows are worked out once.  New folders are put in place of the old ones when all rows are
    written, so nothing is overwritten while it is being read, and doing the same upsert
    again gives the same table.  ``bounds`` names a column whose first and last value is kept
    for each folder, for :func:`read_range`.
    """
    spark = incoming.sparkSession
    # The lead keeps Spark from reading folder names back as dates or numbers.
    part = F.concat(F.lit("p-"), F.lit("all") if partition is None else partition)
    rows = materialize(incoming.withColumn("part", part), "incoming")
    ends = [F.min(bounds).alias("low"), F.max(bounds).alias("high")] if bounds else [F.count(F.lit(1)).alias("n")]
    names = materialize(rows.groupBy("part").agg(*ends), "folders")
    stored = read_files(spark, path)
    if bounds:
        _widen_bounds(path, stored, names, bounds)
    # (The comparison tells Spark that the names are a selection.)
    old = rows.limit(0) if stored is None else _within(stored, names.where("part >= 'p-'"))
    # Rebalancing brings a partition's rows together (few files) but splits a crowded one.
    ready = upsert(old, rows, keys, order).hint("rebalance", "part")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str] = ()) -> DataFrame:
    """``target`` plus the incoming rows whose key it does not have (first per key)."""
    columns = [c for c in target.columns if c in incoming.columns]
    first = keep_latest(incoming.select(*columns), keys, list(order))
    added = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(added, allowMissingColumns=True)


def upsert_many(
    targets: Mapping[str, DataFrame],
    incoming: Mapping[str, DataFrame],
    keys: Mapping[str, list[str]],
    order: list[Column | str] = (),
) -> dict[str, DataFrame]:
    """Every target with its own incoming rows written over it."""
    out = dict(targets)
    for name, rows in incoming.items():
        out[name] = upsert(targets[name], rows, keys[name], order) if name in targets else rows
    return out


def row_identity(df: DataFrame, identity: list[str] | None = None) -> Column:
    """MD5 of the identifying columns (all of them if not given), nulls included."""
    columns = identity or df.columns
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).cast("binary"))


def _one_per_identity(df: DataFrame, identity: list[str] | None, order: list[Column | str]) -> DataFrame:
    """``df`` with ``_identity``, one row for each: the first by ``order``."""
    columns = identity or df.columns
    marked = df.withColumn("_identity", row_identity(df, identity))
    if not identity:
        return marked.dropDuplicates(["_identity"])
    ranks = [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]
    others = [c for c in df.columns if c not in columns]
    window = Window.partitionBy("_identity").orderBy(
        *ranks, F.struct(*[F.col(f"`{c}`") for c in others or columns]).asc()
    )
    return marked.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def new_rows(
    df: DataFrame,
    existing: DataFrame,
    identity: list[str] | None = None,
    order: list[Column | str] = (),
) -> DataFrame:
    """Rows of ``df`` not present in ``existing``, each identity once.

    Copies are dropped inside each task before anything is shuffled, on both
    sides, so a row repeated millions of times costs no more than any other.
    ``order`` decides which of several rows with one identity stays (the first).
    A history that is asked again and again is better kept as hashes: :func:`new_rows_since`.
    """
    marked = _one_per_identity(df, identity, order)
    seen = existing.select(row_identity(existing, identity or df.columns).alias("_identity")).distinct()
    return marked.join(seen, "_identity", "left_anti").drop("_identity")


# Hexadecimal digits of a row's hash that name its folder: 256 folders.
HASH_DIGITS = 2


def _hash_folder(digits: int) -> Column:
    return F.concat(F.lit("p-"), F.substring("_identity", 1, digits)).alias("part")


def remember_rows(df: DataFrame, path: str, identity: list[str] | None = None, digits: int = HASH_DIGITS) -> None:
    """Add the rows' hashes (128 bits each) to the store at ``path``, in folders by their first
    digits.  Hashes the store has are not added again, so a repeated call changes nothing."""
    own = df.select(row_identity(df, identity).alias("_identity")).distinct()
    fresh = materialize(_not_remembered(own, path, digits), "hashes")
    if fresh.isEmpty():
        return
    ready = fresh.select(F.unhex("_identity").alias("hash"), _hash_folder(digits)).hint("rebalance", "part")
    ready.write.mode("append").partitionBy("part").parquet(path)


def _not_remembered(marked: DataFrame, path: str, digits: int) -> DataFrame:
    """Rows (with ``_identity``) whose hash is not stored.  Only the folders their hashes fall in
    are opened, and of these Spark reads what passes a Bloom filter of the rows' hashes."""
    stored = read_files(marked.sparkSession, path)
    if stored is None:
        return marked
    names = materialize(marked.select(_hash_folder(digits)).distinct(), "folders").where("part >= 'p-'")
    seen = stored.join(names, "part", "left_semi").select(F.lower(F.hex("hash")).alias("_identity"))
    return marked.join(seen, "_identity", "left_anti")


def new_rows_since(
    df: DataFrame,
    path: str,
    identity: list[str] | None = None,
    order: list[Column | str] = (),
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """:func:`new_rows` against everything that :func:`remember_rows` has put at ``path``: the
    history's rows are not read again, only hashes of the folders that ``df`` falls in.

    Nothing is remembered by asking; do that when the rows have got where they should."""
    marked = materialize(_one_per_identity(df, identity, order), "delta")
    return _not_remembered(marked, path, digits).drop("_identity")


def ensure_view(name: str, source: DataFrame | str, replace: bool = False, spark=None) -> DataFrame:
    """A view over a DataFrame or SQL text: made if missing, remade on request."""
    session = spark or source.sparkSession
    if replace or not session.catalog.tableExists(name):
        frame = session.sql(source) if isinstance(source, str) else source
        frame.createOrReplaceTempView(name)
    return session.table(name)
