"""Mix sources to target weights: hierarchical budgets and seeded token-prefixes.

A budget of tokens goes down a tree, domain to language to source.  At each node the
children share it by weight, but none gets more than its whole subtree can give (its
tokens times the epochs allowed).  What a child cannot take goes to its siblings; only what
a whole subtree cannot take reaches the ancestors' other children.  Each leaf then takes
whole epochs of its documents, and of the last epoch the longest prefix, in an order
seeded by epoch, that fits the rest of its budget.

The prefix is a cut in the hash order.  It is found from sums per hash bucket and the rows
of one bucket per leaf, so no leaf is ever sorted as a whole, and documents are chosen where
they are: only the table of leaves is joined to them.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rollcall.session import materialize

# Hex digits of the hash that make a bucket: 4,096 buckets per leaf.
DIGITS = 3
NOT_SPACE = r"[\x20\x09-\x0D]+"


def token_cost(text: Column) -> Column:
    """Words between ASCII white space, and one for the end of the document."""
    words = F.split(F.coalesce(text, F.lit("")), NOT_SPACE)
    return (F.size(F.array_remove(words, "")) + 1).cast("bigint")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: hex digits, the same for rows of one id."""
    parts = [F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent columns, weight, capacity, offered) with ``budget``.

    With all children of a node taking ``min(capacity, level * weight)``, the level is the
    largest of ``(offered - capacities before) / (weights from here on)``, in order of capacity per
    weight, that this child's own capacity allows.
    """
    beside = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    before = beside.rowsBetween(Window.unboundedPreceding, -1)
    onwards = beside.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        children.withColumn("_taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(onwards))
        .withColumn("_level", (F.col("offered") - F.col("_taken")) / F.col("_weights"))
        .withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("capacity"), F.col("_level")))
    )
    level = F.max("_fits").over(Window.partitionBy(*parent))
    filled = filled.withColumn("_at", level)
    full = F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("_at") * F.col("weight")))
    return filled.withColumn("budget", F.coalesce(full, F.col("capacity").cast("double"))).drop(
        "_taken", "_weights", "_level", "_fits", "_at"
    )


def leaf_budgets(
    supply: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: Column, epochs: int
) -> DataFrame:
    """``supply`` (levels, tokens) with ``budget`` in whole tokens.

    ``weights`` has for each level the weight of a name; a name that is not listed weighs 1.
    """
    nodes = supply.select(F.lit(0).alias("_root"), *levels, (F.col("tokens") * epochs).alias("capacity"))
    above = nodes.groupBy("_root").agg(F.sum("capacity").alias("capacity")).select("_root", total.alias("budget"))
    for depth, level in enumerate(levels):
        parent, here = ["_root", *levels[:depth]], ["_root", *levels[: depth + 1]]
        listed = weights.get(level, {})
        weight = F.lit(1.0)
        for name, own in listed.items():
            weight = F.when(F.col(level) == name, float(own)).otherwise(weight)
        children = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity")).where("capacity > 0")
        children = children.join(above.withColumnRenamed("budget", "offered"), parent)
        children = children.withColumn("weight", weight).withColumn("name", F.col(level)).where("weight > 0")
        above = materialize(shared_out(children, parent).select(*here, "budget"), "budgets")
    # Rounding up by a millionth undoes the rounding of divisions.
    return supply.join(above.drop("_root"), levels).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("bigint"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    share: float = 1.0,
    epochs: int = 2,
    seed: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The chosen rows of ``docs`` with ``epoch`` (from 0): one row per time a document is used.

    ``levels`` names the tree from the top; the budget is ``share`` of the tokens there are.
    A null at a level is the name "".  Every row costs its words and one, so null and empty
    texts cost one.  Rows that repeat an id stand at one place of the order and are taken or
    left together.  A name with weight 0 gets nothing.  A leaf gets less than its budget by
    less than its next document.  An empty table gives an empty result.
    """
    clean = {f"_level{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(levels.values())}
    names = list(clean)
    renamed = {names[i]: weights.get(level, {}) for i, level in enumerate(levels)}
    slim = docs.select(
        F.col(doc_id).alias("_id"), *[c.alias(n) for n, c in clean.items()], token_cost(F.col(text)).alias("tokens")
    )
    slim = materialize(slim, "costs")
    supply = materialize(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "supply")
    total = F.floor(F.col("capacity") / epochs * share)
    leaves = leaf_budgets(supply, names, renamed, total.cast("double"), epochs)
    leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    leaves = materialize(leaves.select(*names, "whole", "rest"), "leaves")

    placed = slim.join(leaves, names).withColumn("_place", _order(seed, F.col("whole"), F.col("_id")))
    placed = placed.withColumn("_bucket", F.substring("_place", 1, DIGITS))
    buckets = placed.groupBy(*names, "rest", "_bucket").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy(*names).orderBy("_bucket"))
    # The bucket in which the budget ends, and what is left when it begins.
    ends = buckets.withColumn("_sum", so_far).where("_sum > rest")
    ends = ends.groupBy(*names).agg(F.min(F.struct("_bucket", (F.col("rest") - F.col("_sum") + F.col("tokens")).alias("left"))).alias("end"))
    ends = materialize(ends.select(*names, "end._bucket", "end.left"), "ends")
    inside = placed.join(ends, [*names, "_bucket"]).groupBy(*names, "_bucket", "left", "_place").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*names).orderBy("_place"))
    last = inside.withColumn("_sum", upto).where("_sum <= left").groupBy(*names).agg(F.max("_place").alias("last"))
    # Nothing of the end bucket may fit: then the cut is the bucket's own name, before all in it.
    cuts = leaves.join(ends, names, "left").join(last, names, "left")
    cuts = cuts.select(*names, F.col("whole").alias("_whole"), F.coalesce("last", "_bucket").alias("_cut"))
    cuts = materialize(cuts, "cuts")

    chosen = docs.withColumns(clean).join(cuts, names)
    extra = F.when(_order(seed, F.col("_whole"), F.col(doc_id)) <= F.col("_cut"), 1).otherwise(0)
    times = F.col("_whole") + F.when(F.col("_cut").isNull(), 0).otherwise(extra)
    chosen = chosen.withColumn("_times", times).where("_times > 0")
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop(*names, "_whole", "_cut", "_times")


# Weights of the corpus query.  The tables have no domain, so sources are put in three.
DOMAINS = ("web", "books", "reference")
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "reference": 2.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def corpus_levels() -> dict[str, Column]:
    number = F.pmod(F.length("source") + F.ascii(F.substring("source", -1, 1)), F.lit(len(DOMAINS)))
    domain = F.when(number == 0, DOMAINS[0]).when(number == 1, DOMAINS[1]).otherwise(DOMAINS[2])
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
