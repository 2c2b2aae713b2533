"""Pages of an ordered result next to the whole of it."""

from pyspark.sql import functions as F

from rollcall.plans import query
from rollcall.plans.pages import Pages


def test_pages_cover_the_whole_once(spark):
    df = spark.range(5000).selectExpr("id % 7 as a", "if(id % 11 = 0, null, id) as b", "'x' as c").unionByName(spark.sql("select 3L as a, 3L as b, 'x' as c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = Pages(df.repartition(5), [F.col("a").desc(), F.col("b").asc()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pages.sizes) > 1 and sum(pages.sizes.values()) == 5001
    rows = [tuple(r) for k in range(0, 5001, 1700) for r in pages.page(k, 1700).collect()]
    whole = [tuple(r) for r in df.orderBy(F.col("a").desc(), F.col("b").asc()).collect()]
    assert rows == whole
    assert pages.page(6000, 10).count() == 0 and pages.page(4995, 100).count() == 6
    plan = pages.page(100, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan or "PartitionFilters: [isnotnull(_range" in plan
    assert Pages(df.limit(0), [F.col("a").asc()]).page(0, 5).count() == 0


def test_deep_offset_of_a_query(spark, monkeypatch):
    monkeypatch.setattr(query, "DEEP", 50)
    tables = {"t": spark.range(300).selectExpr("id", "id % 3 as k")}
    spec = {"table": "t", "columns": ["id"], "orderBy": [{"eql": "k", "orderByDirection": "desc"}, "id"], "limit": 4, "offset": 150}
    want = sorted(range(300), key=lambda x: (-(x % 3), x))[150:154]
    assert [r.id for r in query.run_query(spec, tables).collect()] == want
    plan = query.run_query(spec, tables)._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan and "TakeOrderedAndProject(limit=4" in plan
