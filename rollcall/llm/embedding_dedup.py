"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learned (on a bounded sample of rows) that makes the signs of the rotated
principal components balanced and close to the vectors.  The signs are the code.  Codes are
cut into substrings, each the key of one hash table; every vector is put in every table, and
vectors that share a bucket are compared by their original components.  Long codes come
from several rotations.  The width and number of the substrings follow from the number of
rows and the recall asked for, by one rule for every size:

    a substring of s bits is shared at cosine c with probability (1 - acos(c) / pi) ** s

Signs are taken around the mean, where the angle is larger: two unit vectors of cosine c
at a squared distance d from the mean have a cosine of 1 - (1 - c) / d there.  The sample's distances
say how many tables that asks for; if they are too many, signs are of the vectors as they are.

Vectors with the same components are one class and are compared once.  A bucket of any
size is cut into cells (``cells.split_groups``), a pair counts only in the first table it
shares, and a cell gives counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.cells import local_roots, map_cells, split_groups
from rollcall.llm.vectors import stacked, with_bytes
from rollcall.operators.identity import components
from rollcall.session import materialize

SAMPLE = 8192
CELL = 768
# Signs are not taken around the mean if that asks for more tables than this.
MOST_TABLES = 256


def table_shape(rows: int, cosine: float, recall: float, spread: np.ndarray) -> tuple[int, int]:
    """(bits of a substring, number of tables) for so many vectors, ``spread`` being squared
    distances of unit vectors from the point that signs are taken around."""
    bits = min(24, max(8, round(math.log2(max(rows, 2))) - 4))
    near = np.clip(1 - (1 - cosine) / np.maximum(spread, 1e-12), -1, 1)
    missed = 1 - (1 - np.arccos(near) / math.pi) ** bits
    tables = 1
    while tables <= MOST_TABLES and (missed**tables).mean() > 1 - recall:
        tables += 1
    return bits, tables


def learn_rotations(sample: np.ndarray, mean: np.ndarray, blocks: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """The matrix that makes ``sign((x - mean) @ matrix)`` the code of a unit vector x.

    Each block is iterative quantisation from its own random start: signs of the rotated
    components, then the rotation that brings the components closest to the signs.
    """
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    parts = centred @ axes
    draw = np.random.default_rng(seed)
    found = []
    for _ in range(blocks):
        rotation, _ = np.linalg.qr(draw.standard_normal((len(axes), len(axes))))
        for _ in range(rounds):
            signs = np.where(parts @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ parts)
            rotation = (left @ right).T
        found.append(axes @ rotation)
    return np.concatenate(found, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling first keeps squares of very large or small numbers finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_links(x: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``a``, one of ``b``) of rows of ``x`` with at least the cosine."""
    units = unit(x)
    close = units[a] @ units[b].T
    i, j = np.nonzero(close >= cosine - 1e-9)
    edge = np.abs(close[i, j] - cosine) < 1e-9
    if edge.any():  # as near as rounding: the plain formula decides
        p, q = x[a[i[edge]]], x[b[j[edge]]]
        plain = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
        keep = ~edge
        keep[edge] = plain >= cosine
        i, j = i[keep], j[keep]
    return a[i], b[j]


def link_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.95,
    recall: float = 0.995,
    sample: int = SAMPLE,
    cell: int = CELL,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id and kept.

    No pair below ``cosine`` is linked; pairs at or above it are found with the expected
    ``recall`` or better.  A vector that is null, empty, zero, holds a null or non-finite
    component, or has another length than most, links with nothing.  Rows with equal
    vectors link with each other.  Rows that repeat an id count as vectors of their own
    within one component.  An empty table gives an empty result.
    """
    everything = materialize(with_bytes(df, vec_id, vector, _nonzero), "vectors")
    valid = everything.where("length(vec) > 0")
    lengths = valid.groupBy((F.length("vec") / 8).cast("int").alias("dims")).count()
    common = lengths.orderBy(F.desc("count"), "dims").first()
    if common is None:
        return everything.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    dims, rows = common["dims"], common["count"]
    valid = valid.where(F.length("vec") == dims * 8)
    some = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(math.ceil(rows / sample))) == 0).select("vec").limit(2 * sample)
    seen = [np.frombuffer(r["vec"], "<f8") for r in some.collect()] or [np.ones(dims)]
    seen = unit(np.stack(seen))
    mean = seen.mean(axis=0)
    bits, tables = table_shape(rows, cosine, recall, ((seen - mean) ** 2).sum(axis=1))
    if tables > MOST_TABLES:
        mean = np.zeros(dims)
        bits, tables = table_shape(rows, cosine, recall, np.ones(1))
    matrix = learn_rotations(seen, mean, math.ceil(bits * tables / dims))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(stacked(batch.column("vec"), "<f8", dims))
            code = ((x - mean) @ matrix >= 0)[:, : bits * tables].reshape(len(x), tables, bits)
            keys = (code * weights).sum(axis=2)
            packed = pa.array([row.astype("<i4").tobytes() for row in keys], pa.binary())
            lists = pa.array(list(keys), pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column("rep"), batch.column("weight"), batch.column("vec"), packed, lists],
                ["rep", "weight", "vec", "codes", "keys"],
            )

    classes = valid.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    schema = "rep bigint, weight bigint, vec binary, codes binary, keys array<bigint>"
    classes = materialize(classes.mapInArrow(encode, schema), "codes")
    placed = classes.select("rep", F.posexplode("keys").alias("table", "_key"))
    placed = placed.select("rep", "table", F.xxhash64("table", "_key").alias("key"))
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = split_groups(placed, "key", "rep", materialize(counts, "buckets"), cell)
    met = met.join(classes.select("rep", "weight", "vec", "codes"), "rep")

    def compare(part: pa.Table) -> pa.Table | None:
        table = part.column("table")[0].as_py()
        x = stacked(part.column("vec"), "<f8", dims)
        codes = stacked(part.column("codes"), "<i4", tables)
        rep, weight, side = (part.column(c).to_numpy() for c in ("rep", "weight", "side"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = near_links(x, first, second if len(second) else first, cosine)
        if not len(second):
            a, b = a[a < b], b[a < b]
        new = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
        a, b = a[new], b[new]
        if not len(a):
            return None
        links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        root = local_roots(len(x), a, b)
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[root[some]]})

    found = materialize(map_cells(met, compare, "rep bigint, links bigint, root bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    pairs = found.where("rep <> root").select(F.greatest("rep", "root").alias("hi"), F.least("rep", "root").alias("lo"))
    roots = components(pairs).withColumnRenamed("node", "rep")
    facts = classes.select("rep", "weight", "vec").join(links, "rep", "left").join(roots, "rep", "left")
    facts = materialize(facts.select("vec", "rep", "weight", "links", "component"), "classes")
    return everything.join(facts, "vec", "left").select(
        "vec_id",
        F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "rep"), F.lit(True)).alias("kept"),
    )


def _nonzero(x: np.ndarray) -> np.ndarray:
    """The vector's doubles with one kind of zero; nothing for a zero vector."""
    return x.astype("<f8") + 0.0 if x.any() else x[:0]
