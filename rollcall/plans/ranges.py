"""Joins of values with intervals, without comparing every value with every interval.

A condition ``low <= value <= high`` has no equality for Spark to shuffle by, so it becomes a
nested loop.  Here both sides get one.  Every interval has a level: the power of two, of a
base width, that is as wide as itself.  At its level it covers two bins or three, so it is
repeated at most that often, however wide it is; a value is repeated once for each level that
occurs, at most ``LEVELS`` times.  Both meet on (level, bin), an ordinary join that Spark splits
where a bin is crowded, and the condition itself stays as a residual.  Each pair meets in
exactly one bin: that of the value at the interval's level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = 64
CROWD = 16


def _number(value: Column, kind: str) -> Column:
    """Where a value lies, as a double that grows with it."""
    return (value.cast("timestamp") if kind == "date" else value).cast("double")


def range_join(
    left: DataFrame,
    right: DataFrame,
    value: Column | str,
    low: Column | str,
    high: Column | str,
    residual: Column | None = None,
    how: str = "inner",
    key: list[str] | None = None,
) -> DataFrame:
    """Pairs of a row of ``left`` and a row of ``right`` with ``low <= value <= high``.

    ``value`` is of the left side, ``low`` and ``high`` of the right; numbers, dates and
    timestamps.  Rows with a null among them, and intervals that end before they begin, match
    nothing.  ``residual`` is a further condition on a pair (for a strict bound, say).  With
    ``how="left"`` rows of ``left`` without a partner stay; ``key`` names the columns that tell
    its rows apart.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a range join is inner or left, not {how}")
    if how == "left" and not key:
        raise ValueError("a left range join needs the key of its left side")
    value, low, high = (F.col(c) if isinstance(c, str) else c for c in (value, low, high))
    kinds = {f.name: f.dataType.typeName() for f in right.select(low.alias("low"), high.alias("high")).schema.fields}
    kinds |= {f.name: f.dataType.typeName() for f in left.select(value.alias("value")).schema.fields}

    spans = right.withColumns({"_low": _number(low, kinds["low"]), "_high": _number(high, kinds["high"])}).where("_low <= _high")
    # One row: the usual width, and below it the levels that occur.
    usual = F.coalesce(F.nullif(F.percentile_approx(F.col("_high") - F.col("_low"), 0.5, 1000).cast("double"), F.lit(0.0)), F.lit(1.0))
    base = spans.agg(usual.alias("base")).scalar()
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2((F.col("_high") - F.col("_low")) / base)).cast("int")))
    spans = spans.withColumn("_level", F.when(F.col("_high") > F.col("_low"), level).otherwise(0))
    width = base * F.pow(F.lit(2.0), F.col("_level"))
    first, last = (F.floor(F.col(c) / width) for c in ("_low", "_high"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(first, last))).drop("_low", "_high")

    met = right.withColumns({"_low": _number(low, kinds["low"]), "_high": _number(high, kinds["high"])}).where("_low <= _high")
    met = met.agg(F.collect_set(F.when(F.col("_high") > F.col("_low"), level).otherwise(0)).alias("levels")).scalar()
    points = left.withColumn("_at", _number(value, kinds["value"])).where(F.col("_at").isNotNull() & ~F.isnan("_at"))
    points = points.withColumn("_at_level", F.explode(met))
    points = points.withColumn("_at_bin", F.floor(F.col("_at") / (base * F.pow(F.lit(2.0), F.col("_at_level"))))).drop("_at")

    fits = (value >= low) & (value <= high)
    if residual is not None:
        fits = fits & residual
    pairs = points.join(spans, (F.col("_at_level") == F.col("_level")) & (F.col("_at_bin") == F.col("_bin")) & fits)
    pairs = pairs.drop("_at_level", "_at_bin", "_level", "_bin")
    if how == "inner":
        return pairs
    alone = left.join(pairs.select(*key).distinct(), key, "left_anti").select(*left.columns)
    return pairs.unionByName(alone, allowMissingColumns=True)


def range_totals(
    left: DataFrame, right: DataFrame, value: Column, low: Column, high: Column, totals: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Rows of ``right``, several each, with parts of totals of the rows of ``left`` in its interval.

    ``totals`` names columns: ("count", "sum", "min" or "max", of a left column).  Parts of counts
    and sums are to be added up, of the others the least or greatest taken; intervals without a
    row of ``left`` have none.  Pairs are never made: values meet in bins of about ``CROWD``, bins
    in ever wider ones, four to one, and an interval takes the widest that lie inside it and
    compares only the values of the two bins that it ends in.
    """
    kinds = {f.name: f.dataType.typeName() for f in right.select(low.alias("low"), high.alias("high")).schema.fields}
    kinds |= {f.name: f.dataType.typeName() for f in left.select(value.alias("value")).schema.fields}
    make = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    merge = {name: (make["sum"] if kind == "count" else make[kind])(name).alias(name) for name, (kind, _) in totals.items()}

    points = left.where(value.isNotNull() & ~F.isnan(_number(value, kinds["value"]))).groupBy(value.alias("_value"))
    points = points.agg(*[make[kind](column).alias(name) for name, (kind, column) in totals.items()])
    points = points.withColumn("_at", _number(F.col("_value"), kinds["value"]))
    size = points.where(F.abs("_at") < 1e300).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("least"), F.max("_at").alias("most")).first()
    n = max(1, size.n // CROWD)
    least, wide = size.least or 0.0, ((size.most or 0.0) - (size.least or 0.0)) / n or 1.0
    steps = max(1, math.ceil(math.log(n + 3, 4)))

    def bin_of(number: Column) -> Column:
        place = F.greatest(F.lit(-1.0), F.least(F.lit(float(n + 1)), (number - least) / wide))
        return F.floor(F.when(F.isnan(number), F.lit(float(n + 1))).otherwise(place)).cast("bigint") + 1

    points = points.withColumn("_bin", bin_of(F.col("_at"))).drop("_at")
    spans = right.withColumns({"_low": low, "_high": high, "_from": bin_of(_number(low, kinds["low"])), "_to": bin_of(_number(high, kinds["high"]))})
    spans = spans.where("_low <= _high")

    ends = spans.withColumn("_bin", F.explode(F.array_distinct(F.array("_from", "_to"))))
    inside = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    # Rows made by explode are more than Spark's estimate of them: neither side goes to the driver whole.
    ends = ends.join(points.withColumnRenamed("_bin", "_at_bin").hint("merge"), (F.col("_bin") == F.col("_at_bin")) & inside)

    nodes = points.groupBy("_bin").agg(*merge.values()).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    nodes = nodes.withColumn("_node", F.expr("shiftright(_bin, 2 * _step)")).groupBy("_step", "_node").agg(*merge.values())
    whole = spans.where("_to - _from > 1").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    # Bins first <= x < last of the level lie inside, those of wider ones that do (at the last level none) left out.
    up = "shiftright(_from + shiftleft(1L, 2 * {0}), 2 * {0})"
    whole = whole.withColumns({
        "_first": F.expr(up.format("_level")), "_last": F.expr("shiftright(_to, 2 * _level)"),
        "_wide_first": F.expr(f"4 * {up.format('(_level + 1)')}"), "_wide_last": F.expr("4 * shiftright(_to, 2 * (_level + 1))"),
    })
    run = "if({0} < {1}, sequence({0}, {1} - 1), cast(array() as array<bigint>))"
    split = f"concat({run.format('_first', '_wide_first')}, {run.format('_wide_last', '_last')})"
    taken = F.expr(f"if(_level < {steps} and _wide_first < _wide_last, {split}, if(_level = {steps} or _wide_first >= _wide_last, {run.format('_first', '_last')}, null))")
    whole = whole.withColumn("_wanted", F.explode(taken))
    whole = whole.join(nodes.hint("merge"), (F.col("_level") == F.col("_step")) & (F.col("_wanted") == F.col("_node")))
    columns = [*right.columns, *totals]
    return ends.select(*columns).unionByName(whole.select(*columns))
