"""Nothing is lost: late rows, long results, large groups, long texts, new columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions.expressions import expression, tool_arithmetic
from rollcall.operators import clean, merge, resources, segments, timeline as tl
from rollcall.plans.query import fetch_by_id
from rollcall.plans.reports import run_report
from rollcall.session import scratch_path
from rollcall.sources import delimited
from rollcall.streaming import timeline as st


def deliver(spark, path, days):
    """One file per day, in the order given; two entries and two people a day."""
    for n, day in enumerate(days):
        rows = [(f"e{day}-{k}", dt.datetime(2024, 1, day, k), k, 1) for k in range(2)]
        spark.createDataFrame(rows, "id string, ts timestamp, person_id long, entry_type_id long").coalesce(1).write.mode("append").parquet(path)


def test_backfill_is_kept(spark):
    path, out = scratch_path(spark, "late"), scratch_path(spark, "out")
    deliver(spark, path, [31, 1, 2, 1])
    schema = spark.read.parquet(path).schema
    rows = st.stream_timeline_dedupe(st.stream_inputs(spark, path, schema, files_per_batch=1, from_path=False))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "marks"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["e1-0", "e1-1", "e2-0", "e2-1", "e31-0", "e31-1"]


def test_statistics_count_late_days_exactly(spark):
    path, stored, out = (scratch_path(spark, x) for x in ("late", "timeline", "statistics"))
    deliver(spark, path, [31, 1, 2, 1])
    schema = spark.read.parquet(path).schema
    rows = st.stream_inputs(spark, path, schema, files_per_batch=1, from_path=False, file_time="at")
    st.stream_statistics(rows, stored, out, scratch_path(spark, "marks"), ["at"]).awaitTermination()
    got = sorted((r.date, r.records, r.distinct_people) for r in st.read_statistics(spark, out, ["date"]).collect())
    assert got == [("2024-01-01", 2, 2), ("2024-01-02", 2, 2), ("2024-01-31", 2, 2)]


def test_reports_and_lookups_return_all_rows(spark):
    rows = spark.range(3000)
    report = {"data_sources": {"default": {"table": "t"}}, "components": {"c": {"dimension": "id", "metric": {"eql": "count(*)"}}}}
    assert run_report(report, {"t": rows})["c"].count() == 3000
    assert run_report(report, {"t": rows}, {"limit": 0})["c"].count() == 3000
    assert run_report(report, {"t": rows}, {"limit": 7})["c"].count() == 7
    assert fetch_by_id(rows, "id").count() == 3000


def test_any_number_of_folders_is_reloaded(spark):
    path = scratch_path(spark, "folders")
    rows = spark.range(40).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("v"))
    for _ in range(2):
        merge.upsert_files(path, rows, ["id"], F.col("id").cast("string"))
        assert spark.read.parquet(path).count() == 40
    stored = spark.read.parquet(path)
    touched = merge._within(stored, stored.where("id in (1, 2) and part >= 'p-'"))
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
    assert touched.count() == 2


def test_parts_stay_in_deltas_and_files(spark):
    members = spark.createDataFrame([(1,), (2,)], "person_id long")
    orders = spark.createDataFrame([(1, k) for k in range(10)], "person_id long, n int")
    export = segments.export_people(members, {"orders": orders}, chunk_rows=2)
    delta = segments.export_delta(export, export.where("person_id = 2"), by_person=True)
    assert sorted(r.n for r in delta.select(F.explode("orders.n").alias("n")).collect()) == list(range(10))
    path = scratch_path(spark, "export")
    segments.write_export(export, path)
    assert spark.read.json(path).where("part > 0").count() > 0


def test_children_are_cut_only_on_request(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(1, k) for k in range(60)] + [(2, 99)], "parent long, kid long")
    include = {"kids": {"children": kids, "foreign_key": "parent", "id": "kid"}}
    data, included = resources.resource_query(parents, "p", "id", include)
    assert included.count() == 61 and "truncated" not in data.columns
    data, included = resources.resource_query(parents, "p", "id", include, children_per_parent=5)
    assert included.count() == 6
    assert sorted((r.id, r.truncated) for r in data.collect()) == [(1, True), (2, False)]


def test_long_text_is_kept(spark):
    df = spark.createDataFrame([("x" * 300,)], "note string")
    assert len(clean.coerce(df, {"note": "string"}).first().note) == 300
    assert len(clean.coerce(df, {"note": "string"}, policy="cut").first().note) == 255


def test_details_take_new_columns(spark):
    old = tl.load_details(spark.createDataFrame([("a", 1)], "id string, x int"))
    new = tl.load_details(spark.createDataFrame([("b", 2, "n")], "id string, x int, y string"), old)
    assert sorted((r.id, r.x, r.y) for r in new.collect()) == [("a", 1, None), ("b", 2, "n")]


def test_last_version_wins_by_order(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "id string, kind int, line int")
    for given in (rows, rows.orderBy("line"), rows.orderBy(F.desc("line"))):
        assert [r.kind for r in tl.once(given, ["line"]).collect()] == [1]


def write_text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_each_file_by_its_own_header(spark):
    for skip, top in ((None, []), (2, ["made by hand"])):
        path = scratch_path(spark, "csv")
        write_text(spark, path, [*top, "email,name", "a@x.org,Ann"])
        write_text(spark, path, [*top, "name,email,age", "Bob,b@x.org,7"])
        df = delimited.read_delimited(spark, path, skip=skip)
        assert sorted((r.email, r.name, r.age) for r in df.collect()) == [("a@x.org", "Ann", None), ("b@x.org", "Bob", "7")]
    write_text(spark, path, ["made by hand"])
    with pytest.raises(ValueError, match="no line 2"):
        delimited.read_delimited(spark, path, skip=2)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("a / b", None),
        ("a / (b + 2) / 2", 1.5),
        ("a > 1 xor c = 'p xor q'", True),
        ("(a > 1 xor true) or false", False),
        ("not 1", False),
        ("!b", True),
        ("not b and a = 6", True),
        ("a is not null", True),
        ("cast('2024-01-02 03:04:05' as time)", "03:04:05"),
        ("'1 / 0'", "1 / 0"),
    ],
)
def test_spellings(spark, text, value):
    df = spark.createDataFrame([(6, 0, "x")], "a int, b int, c string")
    assert tool_arithmetic(lambda: df.select(expression(text).alias("v")))().first().v == value
