"""Range joins next to a nested loop, on odd intervals, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.plans.query import run_query
from rollcall.plans.ranges import range_join, range_totals


def both(spark, seed=3):
    draw = random.Random(seed)
    points = [(k, draw.choice([None, float(draw.randint(-50, 50)), draw.uniform(-1e3, 1e3), 1e9, -1e9, float("nan")])) for k in range(200)]
    spans = []
    for k in range(120):
        low = draw.choice([None, draw.uniform(-1e3, 1e3), float(draw.randint(-50, 50))])
        wide = draw.choice([0.0, 1e-9, draw.uniform(0, 5), 300.0, 3e9, -1.0])
        spans.append((k, low, None if low is None or k % 17 == 0 else low + wide))
    return points, spans, spark.createDataFrame(points, "p long, v double"), spark.createDataFrame(spans, "s long, low double, high double")


def test_range_join_equals_nested_loop(spark):
    points, spans, left, right = both(spark)
    want = sorted((p, s) for p, v in points for s, a, b in spans if v is not None and a is not None and b is not None and a <= v <= b)
    got = sorted(tuple(r) for r in range_join(left, right, "v", "low", "high").select("p", "s").collect())
    assert got == want and len(want) > 500
    strict = sorted(tuple(r) for r in range_join(left, right, "v", "low", "high", F.col("v") < F.col("high")).select("p", "s").collect())
    assert strict == [(p, s) for p, s in want if points[p][1] < spans[s][2]]
    outer = range_join(left, right, "v", "low", "high", how="left", key=["p"])
    alone = {p for p, _ in points} - {p for p, _ in want}
    assert {r.p for r in outer.where("s is null").collect()} == alone and outer.count() == len(want) + len(alone)
    with pytest.raises(ValueError):
        range_join(left, right, "v", "low", "high", how="full")
    with pytest.raises(ValueError):
        range_join(left, right, "v", "low", "high", how="left")


def test_range_join_has_an_equality(spark):
    _, _, left, right = both(spark)
    plan = range_join(left, right, "v", "low", "high")._jdf.queryExecution().optimizedPlan().toString()
    assert "_level#" in plan and "Cartesian" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = range_join(left, right, "v", "low", "high")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join_of_times_and_empty_sides(spark):
    left = spark.sql("select timestamp'2024-03-01 10:00:00' as t, 1 as p union all select timestamp'2024-03-02 00:00:00', 2")
    right = spark.sql("select date'2024-03-01' as a, date'2024-03-02' as b, 'x' as s")
    assert {(r.p, r.s) for r in range_join(left, right, "t", "a", "b").collect()} == {(1, "x"), (2, "x")}
    assert range_join(left, right.where("s = 'y'"), "t", "a", "b").count() == 0
    assert range_join(left.where("p = 7"), right, "t", "a", "b").count() == 0
    assert range_join(left, right.where("s = 'y'"), "t", "a", "b", how="left", key=["p"]).count() == 2


def test_totals_by_range_make_no_pairs(spark):
    points, spans, left, right = both(spark, 5)
    points = [(k, v) for k, v in points] + [(1000 + k, float(k % 700) / 3) for k in range(3000)]
    left = spark.createDataFrame(points, "p long, v double")
    spec = {
        "table": "left",
        "columns": [{"table": "right", "column": "s"}, {"eql": "count(*)", "name": "n"}, {"eql": "cast(sum(p) as signed)", "name": "total"},
                    {"eql": "min(p)", "name": "least"}, {"eql": "max(left.v)", "name": "most"}],
        "joins": [{"table": "right", "range": {"value": "left.v", "low": "right.low", "high": "right.high"}}],
        "groupBy": [{"table": "right", "column": "s"}],
    }
    want = {}
    for s, a, b in spans:
        own = [(p, v) for p, v in points if v is not None and a is not None and b is not None and a <= v <= b]
        if own:
            want[s] = (len(own), sum(p for p, _ in own), min(p for p, _ in own), max(v for _, v in own))
    # An interval that comes twice counts twice.
    for times, table in ((1, right), (2, right.union(right))):
        result = run_query(spec, {"left": left, "right": table})
        got = {r.s: (r.n, r.total, r.least, r.most) for r in result.collect()}
        assert got == {s: (n * times, t * times, a, b) for s, (n, t, a, b) in want.items()} and len(got) > 40
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "_node" in plan and "_at_level" not in plan
    assert run_query(spec, {"left": left.where("p < 0"), "right": right}).count() == 0


def test_totals_by_range_broadcast_nothing(spark):
    # What an interval is repeated for is not in Spark's estimate of its size.
    _, _, left, right = both(spark, 6)
    totals = {"n": ("count", F.lit(1))}
    rows = range_totals(left, right, F.col("v"), F.col("low"), F.col("high"), totals)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
