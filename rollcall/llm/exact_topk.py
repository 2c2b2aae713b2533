"""Exact top-k inner products by reading sorted lists without random access.

Every component is a list of (vector, value) sorted by value.  A query reads each list from
the end that suits the sign of its own component, all lists to the same depth.  After each
stretch every vector has a lower and an upper bound: what was read of it, plus for each
component not read yet the least the list holds, or at most the value where reading
stopped.  Vectors whose upper bound is below the k-th best lower bound cannot qualify.
When few others are left, their scores are resolved.

Lists are kept per block of vectors, and a block of queries reads them together, so that a
stretch of reading is a product of small matrices.  Each (vector block, query block) is a
cell; the best k of all cells of a query are its best k.  Blocks bound memory at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.cells import map_cells
from rollcall.llm.vectors import stacked, with_bytes
from rollcall.plans.skew import top_per_group
from rollcall.session import materialize

VECTORS, QUERIES = 4096, 512
DEPTHS = (0.6, 0.8, 0.92)


def whole_numbers(x: np.ndarray, scale: float = 64.0) -> np.ndarray:
    return np.floor(scale * x).astype("<i8")


def read_lists(x: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions that may be among a query's best ``k``; all that are, are in it."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    plus, minus = np.maximum(queries, 0.0).T, np.minimum(queries, 0.0).T
    # What a component adds at least: the far end of its list.
    worst = plus * values[0][:, None] + minus * values[-1][:, None]
    left = None
    for depth in DEPTHS:
        stop = min(n, math.ceil(depth * n))
        top, bottom = (rank >= n - stop).astype(np.float64), (rank < stop).astype(np.float64)
        read = (x * top) @ plus + (x * bottom) @ minus
        # Where reading stopped: no unread value adds more.
        edge_top, edge_bottom = values[n - stop][:, None], values[stop - 1][:, None]
        unread_top, unread_bottom = 1.0 - top, 1.0 - bottom
        lower = read + unread_top @ (plus * values[0][:, None]) + unread_bottom @ (minus * values[-1][:, None])
        upper = read + unread_top @ (plus * edge_top) + unread_bottom @ (minus * edge_bottom)
        best = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(queries), -np.inf)
        left = upper >= best[None, :]
        if left.sum() <= 4 * k * len(queries):
            break
    v, q = np.nonzero(left)
    return q, v


def top_scores(
    df: DataFrame,
    is_query,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    vectors: int = VECTORS,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` best other vectors.

    Scores are inner products of floor(scale * component), ties go to the smaller id.  A
    query with fewer other vectors gets all of them.  Vectors that are null, empty, hold
    null or non-finite components, have another length than most, or have no id take no
    part.  Rows with the query's own id are not its candidates; other repeated rows are each
    a candidate.  An empty table gives an empty result.
    """
    rows = with_bytes(df, vec_id, vector, lambda x: whole_numbers(x, scale))
    rows = materialize(rows.where("vec is not null and vec_id is not null"), "vectors")
    lengths = rows.groupBy(F.length("vec").alias("bytes")).count()
    common = lengths.orderBy(F.desc("count"), "bytes").first()
    if common is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    size, total = common["bytes"], common["count"]
    dims = size // 8
    rows = rows.where(F.length("vec") == size)
    asked = rows.where(is_query(F.col("vec_id")))
    n_blocks, q_blocks = math.ceil(total / vectors), math.ceil(max(1, asked.count()) / queries)
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = rows.select("vec_id", "vec", block(n_blocks, 1).alias("b"), every(q_blocks).alias("q"), F.lit(0).alias("asks"))
    asks = asked.select("vec_id", "vec", block(q_blocks, 2).alias("q"), every(n_blocks).alias("b"), F.lit(1).alias("asks"))
    cells = lists.unionByName(asks).withColumn("cell", F.col("b").cast("bigint") * q_blocks + F.col("q")).drop("b", "q")

    def search(part: pa.Table) -> pa.Table | None:
        ids, asks = part.column("vec_id").to_numpy(), part.column("asks").to_numpy() == 1
        numbers = stacked(part.column("vec"), "<i8", dims)
        x, own, wanted, names = numbers[~asks], ids[~asks], numbers[asks], ids[asks]
        if not len(x) or not len(wanted):
            return None
        # One more than k: the query itself may be among them.
        twins = int(np.unique(own, return_counts=True)[1].max())
        q, v = read_lists(x.astype(np.float64), wanted.astype(np.float64), min(len(x), k + twins))
        keep = names[q] != own[v]
        q, v = q[keep], v[keep]
        scores = np.empty(len(q), np.int64)
        for at in range(0, len(q), 1 << 16):
            end = at + (1 << 16)
            scores[at:end] = (wanted[q[at:end]] * x[v[at:end]]).sum(axis=1)
        order = np.lexsort((own[v], -scores, q))
        q, v, scores = q[order], v[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < k
        return pa.table({"query_id": names[q[best]], "vec_id": own[v[best]], "score": scores[best]})

    found = map_cells(cells, search, "query_id bigint, vec_id bigint, score bigint")
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
