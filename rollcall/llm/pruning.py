"""Joins of a large table with a few wanted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollcall.session import materialize

LEAST = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def materialize_pruned(df: DataFrame, label: str) -> DataFrame:
    """Write and read back ``df``, a join whose smaller side is a selection of keys.

    While the selection is small enough (Spark's own check), Spark sends a Bloom filter of it
    to the scan of the large side, so that only rows that may match are shuffled.  Beyond
    that the join is an ordinary one.
    """
    conf = df.sparkSession.conf
    before = conf.get(LEAST, None)
    conf.set(LEAST, "1MB")
    try:
        return materialize(df, label)
    finally:
        if before is None:
            conf.unset(LEAST)
        else:
            conf.set(LEAST, before)
