"""Joins and numbering that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# A key with more rows than this is joined by broadcast instead of by shuffle.
# N rows have at most N / HOT_ROWS such keys, so what gets broadcast is small
# whatever the data looks like: 10**12 rows allow 250,000 hot keys.
HOT_ROWS = 4_000_000


def join_weighted(facts: DataFrame, keyed: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``facts`` to ``keyed``, which has one row per ``on`` and in ``weight``
    how many rows of ``facts`` carry it.

    Keys heavier than ``hot_rows`` never go through the shuffle: their few ``keyed``
    rows are broadcast.  All other keys take the ordinary join.

    Spark's own skew handling covers joins of two shuffled tables.  This is for a
    ``keyed`` side that was just grouped by the key: it is not shuffled again for
    the join, so Spark has nothing to split there.
    """
    hot = keyed.where(F.col("weight") > hot_rows).drop("weight")
    warm = keyed.where(F.col("weight") <= hot_rows).drop("weight")
    rest = facts.join(F.broadcast(hot.select(on)), on, "left_anti")
    return facts.join(F.broadcast(hot), on).unionByName(rest.join(warm, on))


def dense_ids(keys: DataFrame, key: str, out: str, offset: Column | int = 0, digits: int = 4) -> DataFrame:
    """Number distinct ``key`` values 1, 2, 3 … (plus ``offset``) without a global sort.

    Keys are spread over 16**digits buckets by the leading digits of their MD5,
    numbered inside each bucket, and shifted by the size of the buckets before
    it.  Only the bucket sizes (65,536 rows at most) meet in one task.  The order,
    MD5 then key, depends on the keys alone, so a rerun gives the same numbers.
    """
    spread = keys.select(key, F.md5(F.col(key).cast("string").cast("binary")).alias("_digest"))
    spread = spread.withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        "_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    return spread.join(F.broadcast(starts), "_bucket").select(
        key, (within + F.col("_start") + shift).cast("bigint").alias(out)
    )


def keep_latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the last by ``order``; a hash of the row decides between equals,
    so the choice is the same on every run.

    ``row_number() = 1`` lets Spark drop all but one row per key in every task
    before the shuffle, so a key with a third of the rows ships one row a task.
    """
    ranks = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    others = [c for c in df.columns if c not in keys]
    if not ranks and not others:
        return df.dropDuplicates(keys)
    if others:
        ranks.append(F.xxhash64(*[F.col(f"`{c}`") for c in others]).desc())
    window = Window.partitionBy(*keys).orderBy(*ranks)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``; pre-cut in each task."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
