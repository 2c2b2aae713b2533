"""Vectors as bytes, checked inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def vector_bytes(column: pa.Array, turn: Callable[[np.ndarray], np.ndarray]) -> list[bytes | None]:
    """``turn`` of each vector's doubles, as bytes; null where the vector or a component is
    null or not finite, or the vector is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return []
    offsets = column.offsets.to_numpy()
    flat = column.values
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = whole & (finite[offsets[1:]] == finite[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
    return [
        turn(values[a:b]).tobytes() if ok else None
        for ok, a, b in zip(good.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ]


def with_bytes(df: DataFrame, vec_id: str, vector: str, turn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(vec_id, vec): every row's vector as bytes, null where it can take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = pa.array(vector_bytes(batch.column("_v"), turn), pa.binary())
            yield pa.record_batch([batch.column("vec_id"), vec], ["vec_id", "vec"])

    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def stacked(column: pa.Array, dtype: str, dims: int) -> np.ndarray:
    """One row per value of a binary column whose values all have ``dims`` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims)
