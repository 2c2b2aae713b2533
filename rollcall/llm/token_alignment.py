"""Two tokenizers over one text: which tokens cover the same bytes.

Tokenizer A is byte-level and gets a space before the text, B adds its own.  Inside a task,
documents are taken in batches; a batch is two tables of tokens, keyed by document, with the
byte each begins and ends at.  ``merge_asof`` finds for the start of every token of A the
token of B that covers it, and the other way round; the union of both are all overlaps.
Overlaps that end together cut a document into groups.

How often two ids end together in the whole corpus takes a second step.  Tasks count pairs for
blocks of documents; only distinct pairs of a block are shuffled, summed, and sent back to
the block, where its documents look them up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.tokens import BYTE_LETTERS, PLAIN
from rollcall.session import materialize

# Tokens of both sides in a batch, and links in a block.
BATCH, BLOCK = 1 << 18, 1 << 22
SPACE = "▁"
NONE = np.zeros(0, np.int64)
# Merging by rank takes time by the square of a word.
LONGEST = 2000
CACHED = 250_000
# Characters of texts that are encoded together.
TOGETHER = 1 << 18
LONG_WORD = re.compile(rf"\S{{{LONGEST}}}|\s{{{LONGEST}}}")


class ByteSide:
    """Ids of texts by a byte-level BPE file, with a space in front.

    Where ids are the order of the merges (the file is asked), texts go to the library that
    merges by rank, which is several times faster; a text with a word of more than
    ``LONGEST`` characters, and any other model, goes to the library of the file itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are text
        values = {letter: byte for byte, letter in BYTE_LETTERS.items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(values[c] for c in entry) if all(c in values for c in entry) else entry.encode()
        self.ranked = self._ranked(json.loads(self.library.to_str()))

    def _ranked(self, said: dict):
        model, cut = said["model"], said["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and said["normalizer"] is None
        if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        own = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if sorted(own.values()) != list(range(len(own))) or [own[a + b] for a, b in merges] != list(range(256, len(own))):
            return None
        import tiktoken

        ranks = {self.bytes[number]: number for number in own.values()}
        return tiktoken.Encoding("by rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` as it stands."""
        if self.ranked is None or " " * LONGEST in text or max(map(len, text.split(" "))) >= LONGEST:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


class PieceSide:
    """Ids of texts by a sentencepiece model, which adds a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for number in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(number)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.library.is_byte(number) else piece.replace(SPACE, " ").encode())

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` with a space in front."""
        return self.library.encode_as_numpy(text, num_threads=1).astype(np.int64)


class Pair:
    """Both tokenizers, with the bytes and the length of every token.

    Both cut a text before a space and at a line break, so a word between single separators
    has the same ids everywhere.  A worker keeps the words it met, up to ``CACHED``, and asks
    for the new ones of a batch at once.  A text with other separators is encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.flat_a, self.flat_b = (np.array([*own.bytes, None], object)[:-1] for own in (self.a, self.b))
        self.length_a, self.length_b = (np.array([len(x) for x in own.bytes], np.int64) for own in (self.a, self.b))
        # An id with what follows it in a digest.
        self.ids = max(len(self.length_a), len(self.length_b))
        self.said = np.array([f"{i}{end}" for end in ",|;" for i in range(self.ids)], object)
        spaces = self.b.library.id_to_piece(list(range(len(self.b.bytes))))
        self.apart = self.a.ranked is not None and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in spaces)
        # By word, or by line break and word: ids, or None if it cannot stand alone.
        self.words_a: dict[str, bytes | None] = {}
        self.words_b: dict[str, bytes | None] = {}

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for each text; none for one whose bytes a side does not give back."""
        units = [text.replace("\n", " \n").split(" ") if text and self.apart else [] for text in texts]
        self.learn(units)
        out = []
        for text, own in zip(texts, units, strict=True):
            if not text:
                out.append((NONE, NONE))
                continue
            try:
                a, b = b"".join(map(self.words_a.__getitem__, own)), b"".join(map(self.words_b.__getitem__, own))
            except TypeError:  # one of them is None
                a = b = b""
            if a and b:
                out.append((np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")))
            else:
                out.append(self.whole(text))
        return out

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = (" " + text).encode("utf-8", "surrogatepass")
        b = self.b.encode(text)
        if not covers(raw, b, self.length_b, self.flat_b):
            return NONE, NONE
        a = np.array(self.a.encode(" " + text), np.int64)
        return (a, b) if covers(raw, a, self.length_a, self.flat_a) else (NONE, NONE)

    def learn(self, units: list[list[str]]) -> None:
        if len(self.words_a) > CACHED:
            self.words_a.clear()
            self.words_b.clear()
        new = list(set().union(*units).difference(self.words_a))
        spaced, broken = ["a"], []
        for unit in new:
            word = unit[1:] if unit.startswith("\n") else unit
            if len(word) < LONGEST and PLAIN.fullmatch(word) and SPACE not in word:
                (broken if unit[0] == "\n" else spaced).append(unit)
            else:
                self.words_a[unit] = self.words_b[unit] = None
        # One text of all new words, cut at their ends.
        text = " ".join(spaced) + "".join(broken)
        sizes = [len(u.encode("utf-8", "surrogatepass")) for u in (*spaced, *broken)]
        ends = np.cumsum(np.array(sizes) + np.append(np.ones(len(spaced), int), np.zeros(len(broken), int)))
        raw = (" " + text).encode("utf-8", "surrogatepass")
        ids_a = np.array(self.a.ranked.encode_ordinary(" " + text), np.int64)
        ids_b = self.b.encode(text)
        self.keep(self.words_a, [*spaced, *broken], ends, raw, ids_a, self.length_a, self.flat_a)
        self.keep(self.words_b, [*spaced, *broken], ends, raw, ids_b, self.length_b, self.flat_b)

    @staticmethod
    def keep(known: dict, units: list[str], ends: np.ndarray, raw: bytes, ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> None:
        stops = np.cumsum(lengths[ids])
        at = np.searchsorted(stops, ends)
        if not covers(raw, ids, lengths, table) or (stops[at] != ends).any():
            known.update(dict.fromkeys(units))  # these texts are encoded whole
            return
        data, at = ids.astype("<u4").tobytes(), ((at + 1) * 4).tolist()
        known.update(zip(units, [data[i:j] for i, j in zip([0, *at], at)], strict=False))


def covers(raw: bytes, ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> bool:
    """Whether the tokens' bytes, joined, are ``raw``."""
    return int(lengths[ids].sum()) == len(raw) and b"".join(table[ids].tolist()) == raw


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """A batch: one row per token of each side, one per overlap, and one per link."""

    a: pd.DataFrame  # doc, start, end, id; end counts from the batch's first byte
    b: pd.DataFrame
    overlaps: pd.DataFrame  # k_a, k_b: rows of a and b
    links: pd.DataFrame  # of those, what ends together


def side(ids: list[np.ndarray], lengths: np.ndarray) -> pd.DataFrame:
    flat = np.concatenate(ids).astype(np.int64) if ids else NONE
    end = np.cumsum(lengths[flat])
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return pd.DataFrame({"doc": doc, "start": end - lengths[flat], "end": end, "id": flat, "k": np.arange(len(flat))})


def align(own: Pair, encoded: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
    """Overlaps and links of a batch of documents, encoded by both sides.

    Both sides of a document have the same bytes, so a byte of the batch is the same on both.
    """
    a = side([x for x, _ in encoded], own.length_a)
    b = side([y for _, y in encoded], own.length_b)
    at = ["doc", "start", "k"]
    in_b = pd.merge_asof(a[at], b[at], on="start", by="doc", suffixes=("_a", "_b"))
    in_a = pd.merge_asof(b[at], a[at], on="start", by="doc", suffixes=("_b", "_a"))
    # Tokens that begin together are found from both sides; the second side leaves them out.
    new = a["start"].to_numpy()[in_a["k_a"].to_numpy()] != in_a["start"].to_numpy()
    both = pd.concat([in_b[["k_a", "k_b"]], in_a.loc[new, ["k_a", "k_b"]]])
    key = (both["k_a"].to_numpy() << 32) | both["k_b"].to_numpy()
    both = both.iloc[np.argsort(key, kind="stable")]
    ends = a["end"].to_numpy()[both["k_a"].to_numpy()] == b["end"].to_numpy()[both["k_b"].to_numpy()]
    return Aligned(a, b, both, both[ends])


def groups(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every token of A and of B, numbered through the batch, and each group's document."""
    first = found.links["k_a"].to_numpy()  # a byte ends one token of a side at most: no token is empty
    ends = found.a["end"].to_numpy()[first]
    of_a = np.searchsorted(ends, found.a["end"].to_numpy())
    of_b = np.searchsorted(ends, found.b["end"].to_numpy())
    return of_a, of_b, found.a["doc"].to_numpy()[first]


def digests(own: Pair, found: Aligned, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every document, hashed; nothing for one without tokens."""
    of_a, of_b, doc = groups(found)
    last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (of_a, of_b))
    # Groups in order, A before B in each, tokens as they stand.
    order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
    ids = np.concatenate([found.a["id"].to_numpy(), found.b["id"].to_numpy()])
    ends = np.concatenate([last_a.astype(np.int64), last_b.astype(np.int64) * 2])
    said = own.said[(ends * own.ids + ids)[order]].tolist()
    stops = np.cumsum(np.bincount(found.a["doc"], minlength=n) + np.bincount(found.b["doc"], minlength=n)).tolist()
    out, begin = [], 0
    for stop in stops:
        text = "".join(said[begin:stop])[:-1]
        out.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        begin = stop
    return out


def batches_of(rows: Iterator[pa.RecordBatch], own: Pair) -> Iterator[tuple[list, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids of documents, what they encode to), so many at a time that their tokens are a batch."""
    names: list = []
    encoded: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[str | None] = []
    size = letters = 0
    for batch in rows:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            names.append(name)
            waiting.append(text.as_py())
            letters += len(waiting[-1] or "")
            if letters < TOGETHER and len(waiting) < TOGETHER >> 6:
                continue
            more = own.encode(waiting)
            encoded += more
            size += sum(len(a) + len(b) + 16 for a, b in more)
            waiting, letters = [], 0
            if size > BATCH:
                yield names, encoded
                names, encoded, size = [], [], 0
    if names:
        yield names, encoded + own.encode(waiting)


def alignments(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its tokens, overlaps and groups: (doc_id, a_ids, b_ids, a_ends, b_ends,
    overlap_a, overlap_b, group_a, group_b).

    Ends are bytes of the text with its space; overlaps are places of tokens in a_ids and
    b_ids; group_a and group_b are the group of each token.  A null or empty text, or one whose
    bytes a side does not give back (B knows no U+2581, for it reads as a space), has empty
    lists.  Repeated rows and ids stay rows of their own; other columns are left out.
    """
    kinds = ["a_ids", "b_ids", "a_ends", "b_ends", "overlap_a", "overlap_b", "group_a", "group_b"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(path_a, path_b)
        for names, encoded in batches_of(rows, own):
            n = len(names)
            found = align(own, encoded)
            of_a, of_b, doc = groups(found)
            k_a, k_b = found.overlaps["k_a"].to_numpy(), found.overlaps["k_b"].to_numpy()
            doc_a, doc_b = found.a["doc"].to_numpy(), found.b["doc"].to_numpy()
            many_a, many_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
            start_a, start_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
            size = np.zeros(n, np.int64)
            np.maximum.at(size, doc_a, found.a["end"].to_numpy())
            base = np.append(0, np.maximum.accumulate(size))[:-1]
            many_g = np.bincount(doc, minlength=n)
            start_g = np.cumsum(many_g) - many_g
            of_doc = doc_a[k_a]
            values = [found.a["id"], found.b["id"], found.a["end"] - base[doc_a], found.b["end"] - base[doc_b], k_a - start_a[of_doc], k_b - start_b[of_doc], of_a - start_g[doc_a], of_b - start_g[doc_b]]
            docs_of = [doc_a, doc_b, doc_a, doc_b, of_doc, of_doc, doc_a, doc_b]
            lists = []
            for value, by in zip(values, docs_of, strict=True):
                offsets = np.append(0, np.cumsum(np.bincount(by, minlength=n))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(value, np.int32))))
            yield pa.record_batch([pa.array(names, pa.int64()), *lists], ["doc_id", *kinds])

    schema = "doc_id bigint, " + ", ".join(f"{k} array<int>" for k in kinds)
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, n_links bigint, groups_sha256 string"


def _digested(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents, with the distinct pairs their links have as places in the list of
    their block; and for each block one row of that list (doc_id null, whole true)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(path_a, path_b)
        task, block, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """The documents held, and the list of their pairs."""
            keys, places = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            times = np.concatenate([x[2] for x in held])
            sums = np.bincount(places, weights=times, minlength=len(keys)).astype(np.int64)
            number, begin = (task << 32) | block, 0
            for table, own_keys, own_times, per_doc in held:
                stop = begin + len(own_keys)
                offsets = pa.array(np.append(0, np.cumsum(per_doc)).astype(np.int32))
                at = pa.ListArray.from_arrays(offsets, pa.array(places[begin:stop].astype(np.int32)))
                n = pa.ListArray.from_arrays(offsets, pa.array(own_times.astype(np.int32)))
                begin = stop
                columns = [pa.array(table[c], from_pandas=True) for c in table]
                none = pa.nulls(len(table), pa.list_(pa.int64()))
                yield pa.record_batch([*columns, pa.array(np.full(len(table), number)), at, n, none, none], schema=arrow)
            listed = [pa.array([x], pa.list_(pa.int64())) for x in (keys, sums)]
            empty = [pa.nulls(1, f.type) for f in list(arrow)[:-5]]
            yield pa.record_batch([*empty, pa.array([number]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), *listed], schema=arrow)
            held.clear()

        for names, encoded in batches_of(rows, own):
            n = len(names)
            found = align(own, encoded)
            k_a, k_b = found.links["k_a"].to_numpy(), found.links["k_b"].to_numpy()
            doc = found.a["doc"].to_numpy()[k_a]
            key = (found.a["id"].to_numpy()[k_a] << 32) | found.b["id"].to_numpy()[k_b]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(key)))
            overlapping = np.bincount(found.a["doc"].to_numpy()[found.overlaps["k_a"].to_numpy()], minlength=n)
            table = pd.DataFrame({
                "doc_id": pd.array(names, "Int64"),
                "n_a": np.bincount(found.a["doc"], minlength=n),
                "n_b": np.bincount(found.b["doc"], minlength=n),
                "n_groups": np.bincount(groups(found)[2], minlength=n),
                "n_overlaps": overlapping,
                "n_links": np.bincount(doc, minlength=n),
                "groups_sha256": digests(own, found, n),
            })
            held.append((table, key[at], times, np.bincount(doc[at], minlength=n)))
            size += len(at) + n
            if size > BLOCK:
                yield from flush()
                block, size = block + 1, 0
        if held:
            yield from flush()

    arrow = pa.schema([
        *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")],
        ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())),
        ("keys", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
    ])
    return docs.mapInArrow(run, DIGEST + ", block bigint, at array<int>, n array<int>, keys array<bigint>, sums array<bigint>")


def _look_up(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with what the corpus counts for their links."""
    many, best = np.zeros(len(counts) + 1, np.int64), np.zeros(len(counts) + 1, np.int64)
    many[counts["place"].to_numpy(np.int64)] = counts["c"].to_numpy(np.int64)
    best[counts["place"].to_numpy(np.int64)] = counts["best"].to_numpy(np.int64)
    out = docs.drop(columns=["block", "at", "n"])
    lists = list(zip(docs["at"], docs["n"], strict=True))
    out["n_best"] = [int(np.dot(n.astype(np.int64), best[at])) for at, n in lists]
    out["count_sum"] = [int(np.dot(n.astype(np.int64), many[at])) for at, n in lists]
    return out


def aligned_counts(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: tokens, groups, overlaps and links, the digest of its groups, how
    many of its links have the pair its id of B is linked by most often in the corpus (ties
    included), and the sum of its links' counts.

    Odd texts are as in ``alignments``: their numbers are zero and their digest is empty.
    """
    own = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    rows = materialize(_digested(own, path_a, path_b), "alignments")
    listed = rows.where("keys is not null")
    # Pairs as numbers: the id of A above, the id of B below 32 bits.
    counted = listed.select(F.explode(F.arrays_zip("keys", "sums")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.sums").alias("c"))
    counted = materialize(counted.withColumn("b", F.expr("cast(key & 4294967295 as int)")), "alignment-pairs")
    top = counted.groupBy("b").agg(F.max("c").alias("most"))
    known = counted.join(top, "b").select("key", "c", (F.col("c") == F.col("most")).cast("int").alias("best"))
    asked = listed.select("block", F.posexplode("keys").alias("place", "key"))
    counts = asked.join(known, "key").select(F.col("block").alias("_block"), "place", "c", "best")
    own = rows.where("keys is null").drop("keys", "sums")
    schema = DIGEST + ", n_best bigint, count_sum bigint"
    return own.groupBy("block").cogroup(counts.groupBy("_block")).applyInPandas(_look_up, schema)
