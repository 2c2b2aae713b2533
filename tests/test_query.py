import pytest
from pyspark.sql import functions as F

from rollcall.plans.query import fetch_by_id, run_query, with_limit
from rollcall.plans.reports import run_report
from rollcall.operators.segments import rules_to_predicate


@pytest.fixture(scope="module")
def people(spark):
    person = spark.createDataFrame([(1, "Ann", 5), (2, "Bob", None), (3, "Cy%d", 7)], "id long, name string, score int")
    email = spark.createDataFrame(
        [(1, "Work", "a@w.org"), (1, "Home", "a@h.org"), (2, "Home", "b@h.org")], "person_id long, kind string, email string"
    )
    return {"person": person, "person_email": email}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_no_table(spark):
    assert run_query({"table": "dual", "columns": [{"eql": "1 + 1", "name": "two"}]}, {}).first().two == 2


def test_one_table_under_two_names(spark):
    flights = spark.createDataFrame([("F1", "OSL", "CDG"), ("F2", "CDG", "XXX")], "flight string, origin string, target string")
    ports = spark.createDataFrame([("OSL", "Oslo"), ("CDG", "Paris")], "code string, city string")
    spec = {
        "table": "flights",
        "joins": [
            {"table": "ports", "alias": "here", "join_eql": "flights.origin = here.code"},
            {"table": "ports", "alias": "there", "type": "left", "join_eql": "flights.target = there.code"},
        ],
        "columns": [{"eql": "flights.flight", "name": "flight"}, {"eql": "here.city", "name": "start"}, {"eql": "there.city", "name": "stop"}],
    }
    assert rows(run_query(spec, {"flights": flights, "ports": ports})) == [("F1", "Oslo", "Paris"), ("F2", "Paris", None)]


def test_aggregate_of_an_aggregate(spark):
    readings = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 6.0), ("b", 1, 1.0), ("b", 1, 3.0)], "site string, day int, level double")
    spec = {
        "table": "daily",
        "subquery": {
            "table": "readings",
            "columns": ["site", {"eql": "max(level)", "name": "peak"}],
            "groupBy": ["site", "day"],
        },
        "columns": ["site", {"eql": "avg(peak)", "name": "usual_peak"}],
        "groupBy": ["site"],
    }
    assert rows(run_query(spec, {"readings": readings})) == [("a", 5.0), ("b", 3.0)]


def test_contains_is_literal(people):
    spec = {
        "table": "person", "columns": ["id"],
        "conditions": [{"type": "CONTAINS", "values": [{"ref": {"column": "name"}}, {"value": {"value": "%"}}]}],
    }
    assert rows(run_query(spec, people)) == [(3,)]


def test_global_aggregate_and_distinct(people):
    assert run_query({"table": "person", "columns": [{"eql": "count(*)", "name": "n"}]}, people).first().n == 3
    spec = {"table": "person_email", "columns": [{"eql": "distinct kind", "name": "kind"}]}
    assert rows(run_query(spec, people)) == [("Home",), ("Work",)]


@pytest.mark.parametrize(
    "change, message",
    [
        ({"columns": []}, "no columns"),
        ({"table": None}, "table required"),
        ({"columns": [{"eql": "1"}]}, "name is required"),
        ({"groupBy": ["nope"]}, "no such column"),
        ({"orderBy": ["nope"]}, "no such column"),
        ({"orderBy": [{"column": "id", "orderByDirection": "up"}]}, "asc or desc"),
        ({"limit": "ten"}, "invalid limit"),
        ({"joins": [{"table": "person_email"}]}, "join_eql"),
        ({"joins": [{"table": "person_email", "join_eql": "1=1", "type": "sideways"}]}, "join type"),
        ({"conditions": [{"type": "SOUNDS_LIKE", "values": []}]}, "unknown condition"),
    ],
)
def test_refusals(people, change, message):
    with pytest.raises(ValueError, match=message):
        run_query({"table": "person", "columns": ["id"], **change}, people)


def test_limit_and_fetch(people):
    person = people["person"].orderBy("id")
    assert with_limit(person, 0).count() == 3
    assert [r.id for r in with_limit(person, "1", 1).collect()] == [2]
    assert [r.id for r in fetch_by_id(people["person"], "id", 2).collect()] == [2]


def test_filter_reaches_the_scan(tables):
    tables.spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    spec = {
        "table": "orders",
        "columns": ["o_orderkey"],
        "conditions": [{"eql": "o_orderdate >= '1998-01-01' and o_orderstatus = 'F'"}],
    }
    plan = run_query(spec, tables.named("orders"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan


def test_report_text_and_errors(people):
    report = {
        "data_sources": {"default": {"table": "person"}},
        "components": {"title": "People", "n": {"metric": {"eql": "count(*)", "name": "n"}}, "plain": {"query": {"table": "person", "columns": ["id"]}}},
    }
    out = run_report(report, people)
    assert out["title"] == "People" and out["n"].first().n == 3 and out["plain"].count() == 3
    with pytest.raises(ValueError, match="no data source"):
        run_report({"data_sources": {}, "components": {"x": {"data_source": "gone"}}}, people)


def test_rules(people):
    rule = {"combinator": "or", "rules": [{"field": "name", "operator": "beginsWith", "value": "A"}, {"field": "score", "operator": "null"}]}
    assert rows(people["person"].where(rules_to_predicate(rule)).select("id")) == [(1,), (2,)]
    assert people["person"].where(rules_to_predicate({"combinator": "and", "rules": []})).count() == 3
    with pytest.raises(ValueError):
        rules_to_predicate({"field": "name", "operator": "resembles", "value": "A"})
