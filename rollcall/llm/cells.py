"""Work on groups of any size in bounded pieces.

A *cell* is a group, or a part of one, that a task handles at once.  Rows are dealt
out by cell and sorted, and each task streams through its cells, so a task holds one
cell at a time and a group that owns a third of all rows is spread over many cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def split_groups(rows: DataFrame, key: str, member: str, counts: DataFrame, size: int) -> DataFrame:
    """``rows`` once for every cell they take part in: ``cell`` and ``side``.

    ``counts`` (key, members, already written) has the keys with two rows or more.  A key
    with up to ``size`` rows is one cell (side 0).  A larger one is cut into
    parts by a hash of the member, and every two parts meet in a cell, one of them as
    side 0 and the other as side 1; a part alone is a cell of its own.  So each two rows of
    a key meet in exactly one cell.
    """
    parts = F.ceil(F.col("members") / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), member), F.col("_parts")).cast("int")
    rows = rows.join(counts.select(key, parts.alias("_parts")), key).withColumn("_own", own)
    low = F.least(F.col("_own"), F.col("_other"))
    high = F.greatest(F.col("_own"), F.col("_other"))
    return (
        rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("cell", F.xxhash64(key, low, high))
        .withColumn("side", F.when(F.col("_own") == low, 0).otherwise(1).cast("int"))
        .drop("_parts", "_own", "_other")
    )


def map_cells(
    rows: DataFrame,
    work: Callable[[pa.Table], pa.Table | None],
    schema: str,
    cell: str = "cell",
    order: tuple[str, ...] = (),
) -> DataFrame:
    """``work`` on the rows of each cell; what it returns for all cells, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(cell).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            begins = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), len(keys)]
            for a, b in zip(begins, ends, strict=True):
                if held and keys[a] != last:
                    yield from _worked(work, held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held:
            yield from _worked(work, held)

    dealt = rows.repartition(cell).sortWithinPartitions(cell, *order)
    return dealt.mapInArrow(run, schema)


def _worked(work, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = work(pa.Table.from_batches(held))
    if found is not None and found.num_rows:
        yield from found.to_batches()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The component of each of ``n`` items under links a-b, as its smallest item."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root
