"""Full text in boolean mode: over a column, or over a positional inverted index.

A search is ``+must -never "a phrase" prefix* (either of these) other``: every + part, no -
part, and if there is no + part, at least one of the others.  A search of - parts alone gives
all texts without them.  Words are runs of letters, digits and underscores, in lower case.

The index is a table (term, doc, version, positions) in folders by the hash of the term, so a
word is looked up in one folder, and sorted by term within files, so that a prefix reads the row groups
of its range.  AND, OR and NOT are joins of lists of documents, which spread by document:
a term that a third of all texts have is many rows of many documents, never one group.
Documents are indexed again by appending under a higher version; older ones no longer count.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.functions.text import WORD_BREAK
from rollcall.operators.merge import read_files, upsert_files
from rollcall.session import materialize

_PART = re.compile(r'\s*(?P<sign>[+-]?)(?:"(?P<phrase>[^"]*)"|(?P<open>\()|(?P<word>[^\s()"+-][^\s()"]*)|(?P<close>\)))')


def parts_of(search: str) -> list[tuple[str, str, object]]:
    """(sign, kind, what) of each part: a word, prefix, phrase (its words) or group (its parts)."""
    stack: list[list] = [[]]
    signs: list[str] = []
    for found in _PART.finditer(search):
        sign = found["sign"] or ""
        if found["open"]:
            stack.append([])
            signs.append(sign)
        elif found["close"]:
            if len(stack) == 1:
                raise ValueError(f"a parenthesis is not opened: {search}")
            inner = stack.pop()
            stack[-1].append((signs.pop(), "group", inner))
        else:
            text = found["phrase"] if found["phrase"] is not None else found["word"]
            own = [w for w in re.split(r"\W+", text.lower()) if w]
            if not own:
                continue
            prefix = found["word"] is not None and text.endswith("*") and len(own) == 1
            kind = "prefix" if prefix else "word" if len(own) == 1 else "phrase"
            stack[-1].append((sign, kind, own if kind == "phrase" else own[0]))
    if len(stack) > 1:
        raise ValueError(f"a parenthesis is not closed: {search}")
    return stack[0]


def words(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORD_BREAK), lambda w: w != "")


def text_matches(text: Column | str, search: str) -> Column:
    """Whether a text fits ``search``; a null text has no words."""
    bag = words(text)
    line = F.concat(F.lit(" "), F.array_join(bag, " "), F.lit(" "))

    def one(kind: str, what) -> Column:
        if kind == "group":
            return every(what)
        if kind == "prefix":
            return F.contains(line, F.lit(f" {what}"))
        return F.contains(line, F.lit(f" {' '.join(what) if kind == 'phrase' else what} "))

    def every(parts: list) -> Column:
        must, never, either = ([one(k, w) for s, k, w in parts if s == sign] for sign in ("+", "-", ""))
        test = reduce(lambda a, b: a & b, must, F.lit(True))
        if either and not must:
            test = reduce(lambda a, b: a | b, either)
        return reduce(lambda a, b: a & ~b, never, test)

    return every(parts_of(search))


def folder(term: Column) -> Column:
    return F.substring(F.md5(term.cast("binary")), 1, 2)


def one_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text): of rows with one id the longest text.  Only texts of ids that repeat are moved."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    repeated = materialize(repeated, "repeated-ids")
    longest = rows.join(repeated, "doc", "left_semi").groupBy("doc").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))
    return rows.join(repeated, "doc", "left_anti").unionByName(longest)


def postings_of(own: DataFrame) -> DataFrame:
    """(term, doc, positions) of ``own`` (doc, text).  A text's words are put in order within its
    row, so that postings are neither moved nor sorted to be made."""
    at_term = F.sort_array(F.transform(words("text"), lambda w, at: F.struct(w.alias("term"), at.alias("at"))))
    placed = own.select("doc", at_term.alias("placed"))

    def begins(k: Column) -> Column:
        return (k == 0) | (F.get("placed", k - 1)["term"] != F.get("placed", k)["term"])

    begun = placed.withColumn("first", F.filter(F.transform("placed", lambda _, k: k), begins))

    def posting(low: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("first", k + 1), F.size("placed"))
        positions = F.transform(F.slice("placed", low + 1, upto - low), lambda x: x["at"])
        return F.struct(F.get("placed", low)["term"].alias("term"), positions.alias("positions"))

    spread = begun.select("doc", F.explode(F.transform("first", posting)).alias("_p"))
    return spread.select("_p.term", "doc", "_p.positions")


def index_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", version: int = 1) -> None:
    """Put ``docs`` into the index at ``path`` (made if missing).

    A document that is in it already is replaced if ``version`` is higher than before; others
    are not touched, and nothing is rebuilt.  Doing the same again changes no result.  Of rows
    with one id the longest text counts; rows without an id are left out.
    """
    own = one_text(docs, doc_id, text)
    postings = postings_of(own)
    postings = postings.withColumns({"version": F.lit(version), "part": F.concat(F.lit("p-"), folder(F.col("term")))})
    # A crowded folder (that of a frequent word) is split into files of even size.
    ready = postings.hint("rebalance", "part").sortWithinPartitions("part", "term", "doc")
    ready.write.mode("append").partitionBy("part").parquet(f"{path}/postings")
    # The versions come last: until they are there, the new postings do not count.
    upsert_files(f"{path}/documents", own.select("doc", F.lit(version).alias("version")), ["doc"], folder(F.col("doc").cast("string")))


def search_index(spark: SparkSession, path: str, search: str) -> DataFrame:
    """(doc) of the documents in the index that fit ``search``."""
    current = read_files(spark, f"{path}/documents")
    postings = spark.read.parquet(f"{path}/postings")
    current = current.select("doc", "version")

    def listed(term: str) -> DataFrame:
        """Documents with the word, and where: one folder is read."""
        own = postings.where((F.col("part") == F.concat(F.lit("p-"), folder(F.lit(term)))) & (F.col("term") == term))
        return own.select("doc", "version", "positions")

    def one(kind: str, what) -> DataFrame:
        if kind == "group":
            return every(what)
        if kind == "prefix":
            found = postings.where((F.col("term") >= what) & (F.col("term") < what + "\U0010ffff")).select("doc", "version")
        elif kind == "word":
            found = listed(what).select("doc", "version")
        else:
            found = listed(what[0]).withColumnRenamed("positions", "starts")
            for k, term in enumerate(what[1:], 1):
                moved = listed(term).select("doc", "version", F.expr(f"transform(positions, at -> at - {k})").alias("_next"))
                found = found.join(moved, ["doc", "version"]).withColumn("starts", F.array_intersect("starts", "_next")).where(F.size("starts") > 0)
                found = found.select("doc", "version", "starts")
            found = found.select("doc", "version")
        return found.join(current, ["doc", "version"], "left_semi").select("doc").distinct()

    def every(parts: list) -> DataFrame:
        must, never, either = ([one(k, w) for s, k, w in parts if s == sign] for sign in ("+", "-", ""))
        if must:
            found = reduce(lambda a, b: a.join(b, "doc", "left_semi"), must)
        elif either:
            found = reduce(lambda a, b: a.unionByName(b), either).distinct()
        else:
            found = current.select("doc")
        return reduce(lambda a, b: a.join(b, "doc", "left_anti"), never, found)

    return every(parts_of(search))
