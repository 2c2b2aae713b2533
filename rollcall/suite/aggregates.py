"""Aggregation (G)."""

from __future__ import annotations

from rollcall.plans.query import run_query
from rollcall.suite import case, plain


def _grouped(t, table, columns, group, **more):
    return plain(run_query({"table": table, "columns": columns, "groupBy": group, **more}, t.named(table)))


@case("g1_count", "select event_type, count(*) as records, count(nullif(user_id, 3)) as known from events group by event_type")
def _(t):
    return _grouped(
        t, "events",
        ["event_type", {"eql": "count(*)", "name": "records"}, {"eql": "count(nullif(user_id, 3))", "name": "known"}],
        ["event_type"],
    )


@case(
    "g2_count_distinct",
    "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1",
)
def _(t):
    return _grouped(
        t, "lineitem",
        [
            "l_returnflag",
            {"column": "l_partkey", "aggregate": "COUNT_DISTINCT", "name": "parts"},
            {"eql": "count(distinct l_suppkey)", "name": "suppliers"},
        ],
        ["l_returnflag"],
    )


@case(
    "g3_sum",
    """select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(19,2))) as double) as total,
       sum(l_quantity) as quantity from lineitem group by 1, 2""",
)
def _(t):
    return _grouped(
        t, "lineitem",
        [
            "l_returnflag",
            "l_linestatus",
            {"eql": "sum(cast(l_extendedprice as decimal(19,2)))", "name": "total"},
            {"column": "l_quantity", "aggregate": "SUM", "name": "quantity"},
        ],
        ["l_returnflag", "l_linestatus"],
    )


@case("g4_average", "select o_orderpriority, round(avg(cast(o_totalprice as decimal(19,2))), 3) as average from orders group by 1")
def _(t):
    return _grouped(
        t, "orders",
        ["o_orderpriority", {"eql": "round(cast(average(cast(o_totalprice as decimal(19,2))) as double), 3)", "name": "average"}],
        ["o_orderpriority"],
    )


@case(
    "g5_min_max",
    """select c_mktsegment, min(c_acctbal) as lowest, max(c_acctbal) as highest, min(c_name) as first_name from customer group by 1""",
)
def _(t):
    return _grouped(
        t, "customer",
        [
            "c_mktsegment",
            {"column": "c_acctbal", "aggregate": "MIN", "name": "lowest"},
            {"column": "c_acctbal", "aggregate": "MAX", "name": "highest"},
            {"column": "c_name", "aggregate": "MIN", "name": "first_name"},
        ],
        ["c_mktsegment"],
    )


@case(
    "g6_group_by_expressions",
    """select o_orderstatus, year(o_orderdate)::bigint as order_year, cast(date_trunc('month', o_orderdate)::date as varchar) as month, count(*) as orders
       from orders group by 1, 2, 3""",
)
def _(t):
    return _grouped(
        t, "orders",
        [
            "o_orderstatus",
            {"eql": "YEAR(o_orderdate)", "name": "order_year"},
            {"eql": "MONTH(o_orderdate)", "name": "month"},
            {"eql": "count(*)", "name": "orders"},
        ],
        ["o_orderstatus", {"eql": "YEAR(o_orderdate)"}, {"eql": "MONTH(o_orderdate)"}],
    )


@case(
    "g7_aggregate_arithmetic",
    """select l_returnflag, round(cast(sum(cast(l_extendedprice as decimal(19,2))) as double) / count(*), 4) as per_item,
       cast(null as double) as nothing from lineitem group by 1""",
)
def _(t):
    return _grouped(
        t, "lineitem",
        [
            "l_returnflag",
            {"eql": "round(cast(sum(cast(l_extendedprice as decimal(19,2))) as double) / count(*), 4)", "name": "per_item"},
            {"eql": "sum(l_tax) / (count(*) - count(*))", "name": "nothing"},
        ],
        ["l_returnflag"],
    )


@case(
    "g8_derived_table",
    """select nations // 5 as fives, cast(max(richest) as double) as richest, count(*) as segments
       from (select c_mktsegment, c_nationkey % 7 as grp, count(distinct c_nationkey) as nations, max(c_acctbal) as richest from customer group by 1, 2) group by 1""",
)
def _(t):
    spec = {
        "table": "slices",
        "subquery": {
            "table": "customer",
            "columns": [
                {"eql": "c_mktsegment", "name": "segment"},
                {"eql": "count(distinct c_nationkey)", "name": "nations"},
                {"eql": "max(c_acctbal)", "name": "richest"},
            ],
            "groupBy": [{"eql": "c_mktsegment"}, {"eql": "c_nationkey % 7"}],
        },
        "columns": [
            {"eql": "floor(nations / 5)", "name": "fives"},
            {"eql": "max(slices.richest)", "name": "richest"},
            {"eql": "count(segment)", "name": "segments"},
        ],
        "groupBy": [{"eql": "floor(nations / 5)"}],
    }
    return run_query(spec, t.named("customer"))


@case(
    "g9_having",
    """select o_custkey, count(*) as orders from orders where o_orderstatus = 'F' group by 1
       having count(*) > 5 and max(o_totalprice) < 450000""",
)
def _(t):
    return _grouped(
        t, "orders",
        ["o_custkey", {"eql": "count(*)", "name": "orders"}],
        ["o_custkey"],
        conditions=[{"eql": "o_orderstatus = 'F'"}],
        having=[{"eql": "count(*) > 5"}, {"eql": "max(o_totalprice) < 450000"}],
    )


STEPS = (
    "case when value < 12.5 then 'a: under 12.5' when value < 37.5 then 'b: to 37.5' when value < 62.5 then 'c: to 62.5'"
    " when value < 87.5 then 'd: to 87.5' else 'e: above' end"
)


@case("g10_bucketed_counts", f"select {STEPS} as step, event_type, count(*) as n from events group by 1, 2")
def _(t):
    columns = [{"eql": STEPS, "name": "step"}, "event_type", {"eql": "count(*)", "name": "n"}]
    return _grouped(t, "events", columns, [{"eql": STEPS}, "event_type"])
