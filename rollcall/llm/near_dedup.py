"""Near-duplicate documents: SetSketch bands, joint likelihood, exact check, components.

Every text becomes the set of its word shingles and a SetSketch of it.  Texts with equal sets
are one class, compared once.  Bands of registers are the keys of candidate groups, found
in two steps:

1. Every group is compared with its first member (a star), which settles groups of close
   copies of any size in as many comparisons as members.
2. Groups that still hold two components are compared within bounded cells: pairs across
   components whose joint likelihood allows the threshold, each pair in the first band
   that it shares.

In both steps links count only when the full sets say so.  Sets are made again from the
texts of those documents that have a candidate; other texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.cells import local_roots, map_cells, split_groups
from rollcall.llm.setsketch import SetSketch, plausible
from rollcall.llm.text import ascii_words, chained, mixed, shingle_set
from rollcall.operators.identity import components
from rollcall.session import materialize

REGISTERS, ROWS = 256, 8
CELL = 512
STAR_CELL = 64
DOUBT = 16.0


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` registers; a band's number is part of its hash."""
    bands = registers.astype(np.uint64).reshape(len(registers), -1, rows)
    number = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(bands), 1), np.uint64)
    return chained([number, *(bands[:, :, r] for r in range(rows))]).view(np.int64)


def sketch_table(docs: DataFrame, width: int, registers: int, rows: int) -> DataFrame:
    """Per row: doc_id, n, the set's 128-bit content hash, registers and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, contents, found = [], [], []
                for text in batch.column("_text").to_pylist():
                    shingles = shingle_set(ascii_words(text), width)
                    n.append(len(shingles))
                    with np.errstate(over="ignore"):
                        pair = np.array([shingles.sum(), mixed(shingles + np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
                    contents.append(pair.tobytes())
                    found.append(sketch.registers(shingles))
                bands = band_keys(np.stack(found), rows)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n": pa.array(n, pa.int64()),
                        "content": pa.array(contents, pa.binary()),
                        "registers": pa.array([x.tobytes() for x in found], pa.binary()),
                        "bands": pa.array(list(bands), pa.list_(pa.int64())),
                    }
                )

    schema = "doc_id bigint, n bigint, content binary, registers binary, bands array<bigint>"
    return docs.mapInArrow(run, schema)


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(rep, set): the shingle hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(ascii_words(x), width).tobytes() for x in batch.column("_text").to_pylist()]
                yield pa.record_batch([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "set"])

    return docs.mapInArrow(run, "rep bigint, set binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (hi, lo) among ``asked`` (cell, rep, partners): a spanning forest of each cell."""

    def run(part: pa.Table) -> pa.Table | None:
        reps = part.column("rep").to_numpy()
        place: dict[int, int] = {}
        asks: dict[int, set[int]] = {}
        data = []
        for rep, partners, own in zip(reps.tolist(), part.column("partners").to_pylist(), part.column("set"), strict=True):
            if rep not in place:
                place[rep] = len(data)
                data.append(np.frombuffer(own.as_buffer(), np.uint64))
            asks.setdefault(place[rep], set()).update(partners or [])
        root = list(range(len(data)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        names = list(place)
        hi, lo = [], []
        for i, partners in asks.items():
            for partner in partners:
                j = place.get(partner)
                if j is None or j == i or top(i) == top(j):
                    continue
                if alike(data[i], data[j], percent):
                    root[top(i)] = top(j)
                    hi.append(max(names[i], names[j]))
                    lo.append(min(names[i], names[j]))
        return pa.table({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64())}) if hi else None

    return map_cells(asked.join(sets, "rep"), run, "hi bigint, lo bigint")


def link_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    width: int = 5,
    registers: int = REGISTERS,
    rows: int = ROWS,
    cell: int = CELL,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Null, empty and white-space texts have no shingles and are linked with nothing; a text
    shorter than a shingle is one shingle.  Rows that repeat an id are one document of the
    component.  Other columns are ignored, and an empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    sketches = materialize(sketch_table(base, width, registers, rows), "sketches")
    filled = sketches.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("content", "n").agg(F.min("doc_id").alias("rep")), "classes")
    owners = filled.join(classes, ["content", "n"]).where("doc_id = rep")
    owners = materialize(owners.dropDuplicates(["rep", "content", "n"]).select("rep", "n", "registers", "bands"), "reps")

    placed = owners.select("rep", F.explode("bands").alias("key"))
    groups = placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("leader"))
    groups = materialize(groups.where("members > 1"), "groups")
    grouped = materialize(placed.join(groups, "key"), "grouped")

    # The sets of all documents that are in a group.
    wanted = materialize(grouped.select("rep").distinct(), "wanted")
    sets = materialize(set_table(wanted.join(base, F.col("rep") == F.col("doc_id")).select("rep", "_text"), width), "sets")

    # Step 1: members beside the first of their group, in cells of one leader each.
    stars = grouped.where("rep <> leader").select("leader", "rep").distinct()
    per_leader = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR_CELL).cast("int").alias("parts"))
    per_leader = materialize(per_leader, "leaders")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    members = stars.join(per_leader, "leader").select(
        F.xxhash64("leader", part).alias("cell"), "rep", F.array("leader").alias("partners")
    )
    leaders = per_leader.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        F.xxhash64("leader", "part").alias("cell"), F.col("leader").alias("rep"), F.lit(None).cast("array<bigint>").alias("partners")
    )
    links = materialize(confirmed(members.unionByName(leaders), sets, percent), "star-links")

    # Step 2: pairs across the components that are left in a group.
    roots = materialize(components(links), "roots")
    labelled = grouped.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    open_groups = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    open_groups = materialize(open_groups.where("a <> b").select("key", "members"), "open-groups")
    met = split_groups(labelled, "key", "rep", open_groups, cell)
    met = met.join(owners.select("rep", "n", "registers"), "rep")
    candidates = map_cells(met, _candidates(registers, rows, percent), "cell bigint, rep bigint, partners array<bigint>")
    more = confirmed(materialize(candidates, "candidates"), sets, percent)
    links = materialize(links.unionByName(more).distinct(), "links")

    found = components(links).withColumnRenamed("node", "rep")
    outcome = classes.join(found, "rep", "left").select(
        "content", "n", F.coalesce("component", "rep").alias("component_id")
    )
    return sketches.join(materialize(outcome, "outcome"), ["content", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"),
        F.coalesce((F.col("n") == 0) | (F.col("doc_id") == F.col("component_id")), F.lit(True)).alias("kept"),
    )


def _candidates(registers: int, rows: int, percent: int):
    def run(part: pa.Table) -> pa.Table | None:
        key = part.column("key")[0].as_py()
        held = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, registers)
        rep, component, n, side = (part.column(c).to_numpy() for c in ("rep", "component", "n", "side"))
        bands = band_keys(held, rows)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        # The band this group is of: the one where all members have the group's key.
        own = int(np.argmax((bands == key).all(axis=0)))
        partners: dict[int, list[int]] = {}
        for i in first.tolist():
            others = second if len(second) else first[first > i]
            others = others[component[others] != component[i]]
            if own and len(others):
                others = others[~(bands[others, :own] == bands[i, :own]).any(axis=1)]
            if len(others):
                mine = np.broadcast_to(held[i], (len(others), registers))
                can = plausible(mine, held[others], np.full(len(others), n[i]), n[others], percent / 100, DOUBT)
                if can.any():
                    partners[i] = rep[others[can]].tolist()
        if not partners:
            return None
        index = {r: k for k, r in enumerate(rep.tolist())}
        rows_out = {*partners, *(index[p] for ps in partners.values() for p in ps)}
        order = sorted(rows_out)
        cell = part.column("cell")[0].as_py()
        return pa.table(
            {
                "cell": pa.array([cell] * len(order), pa.int64()),
                "rep": pa.array(rep[order], pa.int64()),
                "partners": pa.array([partners.get(i, []) for i in order], pa.list_(pa.int64())),
            }
        )

    return run


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, **options) -> DataFrame:
    """``docs`` without the documents that are near copies of another, smaller id."""
    linked = link_documents(docs, doc_id, text, percent=percent, **options).where(~F.col("kept")).select(F.col("doc_id").alias(doc_id))
    return docs.join(linked.distinct(), doc_id, "left_anti")
