"""Mixture-controlled packing of documents into fixed windows of tokens.

Each source is a queue of the tokens of its documents.  A window is filled in rounds over
the queues: a queue's credit grows with its target share, the queue furthest behind its
share gives the next token, and what it is still owed is carried into the next window.  So
after any number of windows every queue has given its share to within one token.

That deficit round-robin has a closed form: token t of a queue of T tokens is due at
(t + 1/2) / T of the whole, and window k takes the tokens due k-th 2048.  So a task needs
only the queues' totals (one number per source) and where its own documents begin in their
queues to know every piece, and the deficits carry over windows and tasks alike.

A target share other than the natural one is a matter of which tokens are in the queues
(see ``source_mix``): packing places every token exactly once.

Queue order is the order of the written token table: file by file, row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rollcall.llm.tokens import encoder
from rollcall.session import materialize

# Sources beyond this many share queues by a hash of their name, so that the totals every
# task holds stay bounded.  All tokens are packed all the same.
MOST_QUEUES = 4096


def due_before(totals: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many tokens each queue has given when ``ranks`` tokens are given: one row per rank.

    Rows sum to their rank exactly and do not decrease from rank to rank.
    """
    t = totals.astype(np.float64)
    all_tokens = int(totals.sum())
    ranks = np.minimum(np.asarray(ranks, np.int64), all_tokens)
    counts = lambda v: np.minimum(np.floor(v[:, None] * t + 0.5).astype(np.int64), totals)
    # Bisect for the last moment at which no more than the rank has been given.  A queue strays by
    # a token at most from its share, which bounds the moment; where rounding breaks that it is any.
    end, near = 1.0 + 1.0 / max(1, t[t > 0].min(initial=1)), len(t) + 1
    low, high = (np.clip((ranks + d) / max(1, all_tokens), 0.0, end) for d in (-near, near))
    low = np.where(counts(low).sum(axis=1) <= ranks, low, 0.0)
    high = np.where(counts(high).sum(axis=1) > ranks, high, end)
    given, soon = counts(low), counts(high)
    left = np.flatnonzero(given.sum(axis=1) < ranks)
    while len(left):
        middle = (low[left] + high[left]) / 2
        move = (middle > low[left]) & (middle < high[left])
        left, middle = left[move], middle[move]
        now = counts(middle)
        sums = now.sum(axis=1)
        fits = sums <= ranks[left]
        low[left[fits]], given[left[fits]] = middle[fits], now[fits]
        high[left[~fits]], soon[left[~fits]] = middle[~fits], now[~fits]
        left = left[sums != ranks[left]]
    # Queues due at the same moment follow in their order.
    room = (ranks - given.sum(axis=1))[:, None]
    extra = soon - given
    before = np.cumsum(extra, axis=1) - extra
    return given + np.clip(room - before, 0, extra)


def rank_of(totals: np.ndarray, queue: np.ndarray, token: np.ndarray, window: int) -> np.ndarray:
    """The window of each (queue, token): what is due up to its own moment tells it to within a
    window or two, bisection over window ends the rest."""

    def inside(ends: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(ends, return_inverse=True)
        return token < due_before(totals, (distinct + 1) * window)[at, queue]

    most = int(totals.sum()) // window
    moment = (token + 0.5) / totals[queue]
    upto = np.minimum(np.floor(moment[:, None] * totals + 0.5), totals).sum(axis=1).astype(np.int64)
    # At one moment at most a token of each queue is due.
    low = np.clip((upto - len(totals) - 1) // window, 0, most)
    high = np.clip(upto // window, 0, most)
    # Where rounding breaks that it is any window.
    low, high = np.where(inside(low - 1), 0, low), np.where(inside(high), high, most)
    while (low < high).any():
        middle = (low + high) // 2
        found = inside(middle)
        high = np.where(found, middle, high)
        low = np.where(found | (low >= high), low, middle + 1)
    return low


def token_table(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str, source: str
) -> DataFrame:
    """Written table: task, source, doc_id, task_start (tokens of the source before it in its
    task), n and ids.  Null text has only the end id; a null source is a source of its own."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        last = np.array([end_id], own.dtype).tobytes()
        task = TaskContext.get().partitionId()
        given: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [own.encode(x) + last for x in batch.column("_text").to_pylist()]
                sizes = [len(x) // own.dtype.itemsize for x in ids]
                starts = []
                names = batch.column("source").to_pylist()
                for name, n in zip(names, sizes, strict=True):
                    starts.append(given.get(name, 0))
                    given[name] = starts[-1] + n
                yield pa.record_batch(
                    {
                        "task": pa.array([task] * len(ids), pa.int32()),
                        "source": pa.array(names, pa.string()),
                        "doc_id": batch.column("doc_id"),
                        "task_start": pa.array(starts, pa.int64()),
                        "n": pa.array(sizes, pa.int64()),
                        "width": pa.array([own.dtype.itemsize] * len(ids), pa.int32()),
                        "ids": pa.array(ids, pa.binary()),
                    }
                )

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("source"),
        F.col(text).alias("_text"),
    )
    schema = "task int, source string, doc_id bigint, task_start bigint, n bigint, width int, ids binary"
    return materialize(rows.mapInArrow(tokens, schema), "tokens")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and
    ids (little-endian unsigned 32-bit).

    Every token of every row lies in exactly one piece.  All sequences but the last are
    full.  Null texts are packed as their end id, repeated rows each, an empty table gives
    no pieces, and other columns are ignored.
    """
    table = token_table(docs, tokenizer, end_id, doc_id, text, source)
    sums = table.groupBy("task", "source").agg(F.sum("n").alias("tokens"))
    sums = materialize(sums, "queue-sums")
    many = sums.select("source").distinct().count() > MOST_QUEUES
    queue = F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string") if many else F.col("source")
    # One number per queue: at most MOST_QUEUES rows.
    totals_of = {r["queue"]: r["tokens"] for r in sums.groupBy(queue.alias("queue")).agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals_of)
    number = {name: k for k, name in enumerate(names)}
    totals = np.array([totals_of[x] for x in names], np.int64)
    # Where each task's part of each source's queue begins.
    order = Window.partitionBy("queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("queue", queue).select(
        "task", "source", "queue", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                yield _pieces(whole.slice(at, 512), totals, number, window)

    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, source string, ids binary"
    )
    packed = table.join(bases, ["task", "source"]).mapInArrow(pieces, schema)
    return packed.withColumn("source", F.when(F.col("source").startswith("="), F.substring("source", 2, 1 << 30)))


def _pieces(batch: pa.RecordBatch, totals: np.ndarray, number: dict[str, int], window: int) -> pa.RecordBatch:
    col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    queue = np.array([number[x] for x in batch.column("queue").to_pylist()], np.int64)
    n, widths = col("n").astype(np.int64), col("width")
    begin = col("base").astype(np.int64) + col("task_start")
    first = rank_of(totals, queue, begin, window)
    last = rank_of(totals, queue, begin + n - 1, window)
    windows = np.unique(np.concatenate([np.arange(a, b + 2) for a, b in zip(first, last, strict=True)]))
    given = due_before(totals, windows * window)
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    at = np.searchsorted(windows, k)
    q = queue[row]
    opens, closes = given[at, q], given[at + 1, q]
    low = np.maximum(begin[row], opens)
    high = np.minimum(begin[row] + n[row], closes)
    keep = high > low
    row, k, at, q, opens, low, high = (x[keep] for x in (row, k, at, q, opens, low, high))
    taken = given[at + 1] - given[at]
    ahead = np.cumsum(taken, axis=1) - taken
    offset = ahead[np.arange(len(q)), q] + (low - opens)
    start, length = low - begin[row], high - low
    ids = batch.column("ids")
    data, crcs, held = [], [], -1
    for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
        if r != held:
            held, tokens = r, np.frombuffer(ids[r].as_buffer(), f"<u{widths[r]}").astype("<u4")
        piece = tokens[s : s + m].tobytes()
        data.append(piece)
        crcs.append(zlib.crc32(piece))
    pick = pa.array(row)
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id").take(pick),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array(crcs, pa.int64()),
            "doc_tokens": batch.column("n").take(pick),
            "sequence_id": pa.array(k),
            "offset": pa.array(offset),
            "source": batch.column("source").take(pick),
            "ids": pa.array(data, pa.binary()),
        }
    )
