"""Token ids in length-delimited binary record files, with an offset index.

A file is a run of frames.  A frame is

    length      8 bytes   of the payload, little-endian
    check 1     4 bytes   masked CRC-32 of the length
    payload     length
    check 2     4 bytes   masked CRC-32 of the payload
    end         1 byte    0x0A

and a payload is

    flags       1 byte    bit 0: the document has no id; bits 4-7: bytes per token id
    document    8 bytes   signed id
    tokens      8 bytes   their number
    ids         bytes per token id times tokens

A checksum is stored as its rotation by 15 bits plus a constant, so that checksums of data
that holds checksums stay meaningful.

Frames are written by Spark's own writer, so only files of finished tasks count, a lost
executor's work is repeated, and the files may lie in any store Spark reaches.  File names
carry the task's number, and files in that order hold ascending document ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rollcall.llm.tokens import encoder
from rollcall.session import materialize

END = b"\n"
HEAD = struct.Struct("<QI")
FIELDS = struct.Struct("<Bqq")
CHECK = struct.Struct("<I")
NO_ID = 1


class BrokenRecord(ValueError):
    """A checksum does not fit its data, or a file ends inside a frame."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload)), END])


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    flags = width << 4 | (NO_ID if doc_id is None else 0)
    return FIELDS.pack(flags, doc_id or 0, len(ids) // width) + ids


def frames_in(content: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length of the frame, payload) for each frame; both checks must fit."""
    at = 0
    while at < len(content):
        if len(content) - at < HEAD.size:
            raise BrokenRecord(f"the file ends inside a frame at {at}")
        length, check = HEAD.unpack_from(content, at)
        if masked(bytes(content[at : at + 8])) != check:
            raise BrokenRecord(f"wrong length check at {at}")
        end = at + HEAD.size + length + CHECK.size + len(END)
        if end > len(content):
            raise BrokenRecord(f"the file ends inside a frame at {at}")
        payload = content[at + HEAD.size : at + HEAD.size + length]
        if masked(payload) != CHECK.unpack_from(content, at + HEAD.size + length)[0] or content[end - 1] != END[0]:
            raise BrokenRecord(f"wrong payload check at {at}")
        yield at, end - at, payload
        at = end


def record_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = FIELDS.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{flags >> 4}", n, FIELDS.size)
    return (None if flags & NO_ID else doc_id), ids


def write_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Every document of ``docs`` as one record of its token ids and ``end_id``.

    Files together are in ascending order of the id, null ids first; rows with equal ids
    are in the order of a hash of their text, and repeated rows are written each.  A null
    or empty text is a record of ``end_id`` alone.  Other columns are ignored.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        last = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            for part in _slices(batch, 256):
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                out = [frame(payload_of(i, own.encode(x) + last, own.dtype.itemsize)) for i, x in rows]
                yield pa.record_batch([pa.array(out, pa.binary())], ["frame"])

    order = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    order = order.withColumn("_hash", F.xxhash64("_text"))
    dealt = order.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash")
    made = dealt.select("_id", "_text").mapInArrow(frames, "frame binary")
    # The text writer puts a string's bytes as they are and ends each with the separator.
    bare = made.select(F.expr(f"substring(frame, 1, length(frame) - {len(END)})").cast("string").alias("value"))
    bare.write.option("lineSep", END.decode()).option("compression", "none").text(path)


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content")


def scan_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every record read back and checked: path, position in the file (record), offset,
    length, doc_id, ids before it in the file (file_start), n_tokens, the ids_crc32 of its ids
    as little-endian unsigned 32-bit numbers, and those ids if they are asked for.  An empty
    folder gives no rows; damage raises."""
    schema = (
        "path string, record bigint, offset bigint, length bigint, doc_id bigint, file_start bigint, "
        "n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, before, file = [], 0, name.as_py()
                for record, (at, length, payload) in enumerate(frames_in(memoryview(content.as_buffer()))):
                    doc, ids = record_of(payload)
                    data = ids.astype("<u4").tobytes()
                    row = (file, record, at, length, doc, before, len(ids), zlib.crc32(data))
                    rows.append((*row, data) if with_ids else row)
                    before += len(ids)
                    if len(rows) == 512:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return _files(spark, path).mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "ids": pa.binary()}
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The offset index of the files in ``path``: one row per record, as Parquet."""
    scan_records(spark, path, with_ids=False).select("path", "record", "offset", "length", "doc_id", "n_tokens").write.parquet(index)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids of the records that ``wanted``, rows of the index in any order, points to."""
    places = wanted.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    joined = _files(spark, path).join(places, "path").select("content", "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1), strict=True):
                whole = memoryview(content.as_buffer())
                for place in places.as_py():
                    one = whole[place["offset"] : place["offset"] + place["length"]]
                    _, _, payload = next(frames_in(one))
                    doc, ids = record_of(payload)
                    yield pa.record_batch(
                        [pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"]
                    )

    return joined.mapInArrow(read, "doc_id bigint, ids array<bigint>")


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens and ids_crc32, from the files.

    The running count inside a file comes from reading it; the files' own starts are summed
    over one row per file.
    """
    found = scan_records(spark, path, with_ids=False).select("path", "doc_id", "file_start", "n_tokens", "ids_crc32")
    found = found.withColumn("_file", F.regexp_extract("path", r"part-(\d+)", 1).cast("int")).drop("path")
    found = materialize(found, "token-offsets")  # read for the totals as well
    totals = found.groupBy("_file").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.coalesce(F.sum("_tokens").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_file", before.alias("_start"))
    return found.join(starts, "_file").select(
        "doc_id", (F.col("_start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )
