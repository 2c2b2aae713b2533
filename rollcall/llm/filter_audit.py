"""How filters interact: what each removes, in every order they can be applied in.

Every document gets a mask with one bit for each filter it fails.  Documents are counted by
part and mask; all that follows works on those cells, at most 2 ** filters of a part.

A recursive query then extends prefixes of filters by letters they do not have yet.  It joins
the masks to each prefix, carries the bits the prefix has applied, and each level of the
recursion says what becomes of a mask at that step: kept, removed, or redundant (its filter
fails it, but another one did before).  The recursion sees masks only, so its size depends on
the number of filters alone; counts are joined to it by mask.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.session import materialize

WORD_GAPS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Orders grow with the factorial: 8 filters are 40,320.
MOST_FILTERS = 8


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, few different words, many capitals, marks."""
    own, whole = words(text), F.coalesce(text, F.lit(""))
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": F.size(own) < 100,
        "B": 100 * F.size(F.array_distinct(own)) < 80 * F.size(own),
        "C": 100 * capitals > 10 * F.length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, filters: Mapping[str, Column], repeats: str | None, doc_id: str, text: str) -> DataFrame:
    """(_id, _part columns kept by the caller, _mask): one row per row of ``docs``.

    ``repeats`` names the filter that fails a text which a row of smaller id has too.  The
    smallest id of a text is found by hash within tasks first, so a text that a third of all
    rows share costs no more than another; the join goes by id and hash, which spreads them.
    """
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(filters.values())]
    mask = reduce(lambda a, b: a + b, bits, F.lit(0))
    own = docs.select(F.col(doc_id).alias("_id"), "_part", mask.alias("_mask"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("_hash"))
    if repeats is None:
        return own.drop("_hash")
    own = materialize(own, "audit-masks")
    first = own.groupBy("_hash").agg(F.min("_id").alias("_id")).where("_id is not null").withColumn("_first", F.lit(True))
    bit = 1 << len(filters)
    later = F.col("_id").isNotNull() & F.col("_first").isNull()
    joined = own.join(first, ["_id", "_hash"], "left")
    return joined.select("_id", "_part", (F.col("_mask") + F.when(later, bit).otherwise(0)).alias("_mask"))


def cells(rows: DataFrame, flags: DataFrame, doc_id: str) -> DataFrame:
    """Counts by part and mask: all rows, and those that ``flags`` calls good or toxic.

    Several labels of one document count as one, good or toxic if any of them is.
    """
    said = flags.groupBy(F.col(doc_id).alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
    )
    counted = rows.join(said, "_id", "left").groupBy("_part", "_mask")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic"))


def walk(masks: DataFrame, letters: str) -> DataFrame:
    """What becomes of every mask at every step of every prefix: (prefix, letter, step, mask,
    kept, removed, redundant, only), the last four as booleans."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or not letters.isalnum():
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters are needed")
    moves = [(applied, letter, 1 << k) for applied in range(1 << len(letters)) for k, letter in enumerate(letters) if not applied >> k & 1]
    values = ", ".join(f"({applied}, '{letter}', {bit})" for applied, letter, bit in moves)
    query = f"""
        with recursive moves(applied, letter, bit) as (values {values}), walked(prefix, letter, step, bit, before, mask) as (
            select m.letter, m.letter, 1, m.bit, 0, c._mask
            from {{masks}} c join moves m on m.applied = c.applied
            union all
            select concat(w.prefix, m.letter), m.letter, w.step + 1, m.bit, w.before | w.bit, w.mask
            from walked w join moves m on m.applied = (w.before | w.bit)
        )
        select prefix, letter, step, mask,
               mask & (before | bit) = 0 as kept,
               mask & before = 0 and mask & bit <> 0 as removed,
               mask & before <> 0 and mask & bit <> 0 as redundant,
               mask = bit as only
        from walked
        """
    # At most 2 ** filters rows.
    own = masks.select("_mask", F.lit(0).alias("applied")).distinct()
    return masks.sparkSession.sql(query, masks=materialize(own.coalesce(1), "audit-masks-met"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of all ``letters`` and step, zeros included.

    ``counted`` is what ``cells`` gives.  An empty table has no parts and gives no rows.
    """
    steps = materialize(walk(counted, letters), "audit-walk")
    # At most (orders x steps) x masks rows, whatever the data: it may go to every task.
    metrics = counted.join(F.broadcast(steps), F.col("mask") == F.col("_mask"))
    total = lambda n, flag: F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).alias
    by_prefix = metrics.groupBy("_part", "prefix", "letter", "step").agg(
        total("n", "kept")("kept"),
        total("n", "removed")("removed"),
        total("n", "redundant")("redundant"),
        total("n", "only")("unique_fails"),
        total("good", "removed")("good_lost"),
        total("toxic", "removed")("toxic_lost"),
    )
    by_prefix = materialize(by_prefix, "audit-prefixes")
    # A prefix stands at the head of as many orders as the letters left can be put in.
    ways = F.lit(1).cast("bigint")
    for step in range(1, len(letters) + 1):
        ways = F.when(F.col("step") == step, factorial(len(letters) - step)).otherwise(ways)
    shares = by_prefix.groupBy("_part", "letter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    heads = steps.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    heads = heads.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("_k"))
    heads = heads.select("filter_order", F.expr("substring(filter_order, 1, _k)").alias("prefix"))
    return by_prefix.join(F.broadcast(heads), "prefix").join(shares, ["_part", "letter"]).select(
        F.col("_part").alias("part"), "filter_order", "step",
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit(
    docs: DataFrame,
    flags: DataFrame,
    filters: Mapping[str, Column] | None = None,
    repeats: str | None = "E",
    part: str = "lang",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every order of ``filters`` (letter to failure condition; ``text_filters`` if none are
    given) and of ``repeats``, the filter for texts that a smaller id has too.

    A null text counts as empty, a condition that is null as not failed, a null part as the
    empty one.  A row without an id neither repeats a text nor is repeated; rows that share an
    id count each.  ``flags`` (doc_id, quality, toxic) may be empty or lack documents; labels
    of unknown documents count nothing.  Other columns are not read.
    """
    filters = text_filters(F.col(text)) if filters is None else dict(filters)
    letters = "".join(filters) + (repeats or "")
    own = docs.withColumn("_part", F.coalesce(F.col(part).cast("string"), F.lit("")))
    rows = masked(own, filters, repeats, doc_id, text)
    return interactions(materialize(cells(rows, flags, doc_id), "audit-cells"), letters)
