"""Query objects: projection, conditions, order, limits, set operations (Q, O, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators.merge import new_rows, new_rows_since, remember_rows
from rollcall.operators.profile import both_ends, profile
from rollcall.operators.segments import segment_people
from rollcall.plans.query import fetch_by_id, keyed_lookup, override_limit, run_query
from rollcall.operators.timeline import stats_by_type, top_groups
from rollcall.session import scratch_path
from rollcall.suite import case, money, plain


def _value(v):
    return {"value": {"value": v}}


def _ref(column, table=None):
    return {"ref": {"column": column, **({"table": table} if table else {})}}


@case("q1_select_columns", "select o_orderkey as order_id, o_custkey, o_orderstatus as status from orders")
def _(t):
    spec = {
        "table": "orders",
        "columns": [
            {"column": "o_orderkey", "name": "order_id"},
            "o_custkey",
            {"table": "orders", "column": "o_orderstatus", "name": "status"},
        ],
    }
    return run_query(spec, t.named("orders"))


@case("q2_select_star", "select customer.* replace (c_nationkey::bigint as c_nationkey) from customer join nation on c_nationkey = n_nationkey")
def _(t):
    spec = {
        "table": "customer",
        "columns": ["*"],
        "joins": [{"table": "nation", "join_eql": "customer.c_nationkey = nation.n_nationkey"}],
    }
    return plain(run_query(spec, t.named("customer", "nation")))


@case(
    "q3_computed_column",
    """select o_orderkey, year(o_orderdate)::bigint as order_year, round(o_totalprice / 100, 4) as hundreds,
       o_orderstatus || '/' || o_orderpriority as tag from orders""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": [
            "o_orderkey",
            {"eql": "year(o_orderdate)", "name": "order_year"},
            {"eql": "round(o_totalprice / 100, 4)", "name": "hundreds"},
            {"eql": "concat(o_orderstatus, '/', o_orderpriority)", "name": "tag"},
        ],
    }
    return plain(run_query(spec, t.named("orders")))


@case("q4_unknown_column_ignored", "select p_partkey, p_brand from part")
def _(t):
    return run_query({"table": "part", "columns": ["p_partkey", "no_such_column", "p_brand"]}, t.named("part"))


@case(
    "q5_function_then_aggregate",
    """select o_orderstatus, cast(max(cast(o_orderdate as date)) as varchar) as last_day,
       count(distinct date_trunc('month', o_orderdate)) as months,
       count(distinct cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as int)) as weeks
       from orders group by o_orderstatus""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": [
            "o_orderstatus",
            {"column": "o_orderdate", "function": "DAY", "aggregate": "MAX", "name": "last_day"},
            {"column": "o_orderdate", "function": "MONTH", "aggregate": "COUNT_DISTINCT", "name": "months"},
            {"column": "o_orderdate", "function": "WEEK", "aggregate": "COUNT_DISTINCT", "name": "weeks"},
        ],
        "groupBy": ["o_orderstatus"],
    }
    return plain(run_query(spec, t.named("orders")))


def _conditions(t, table, columns, *conditions):
    return plain(run_query({"table": table, "columns": columns, "conditions": list(conditions)}, t.named(table)))


@case(
    "q6_equals",
    "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'",
)
def _(t):
    return _conditions(
        t, "orders", ["o_orderkey", "o_orderpriority"],
        {"type": "EQUALS", "values": [_ref("o_orderstatus"), _value("F")]},
        {"type": "NOT_EQUALS", "values": [_ref("o_orderpriority"), _value("1-URGENT")]},
    )


@case(
    "q7_comparisons",
    """select l_orderkey, l_partkey, l_quantity, l_discount from lineitem
       where l_quantity < 40 and l_quantity >= 10 and l_discount > 0.02 and l_discount <= 0.08""",
)
def _(t):
    return _conditions(
        t, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_discount"],
        {"type": "LESS_THAN", "values": [_ref("l_quantity"), _value(40)]},
        {"type": "GREATER_THAN_OR_EQUAL", "values": [_ref("l_quantity"), _value(10)]},
        {"type": "GREATER_THAN", "values": [_ref("l_discount"), _value(0.02)]},
        {"type": "LESS_THAN_OR_EQUAL", "values": [_ref("l_discount"), _value(0.08)]},
    )


@case(
    "q8_contains",
    "select doc_id, source from documents where contains(text, 'th') and not contains(text, '%')",
)
def _(t):
    return _conditions(
        t, "documents", ["doc_id", "source"],
        {"type": "CONTAINS", "values": [_ref("text"), _value("th")]},
        {"type": "DOES_NOT_CONTAIN", "values": [_ref("text"), _value("%")]},
    )


_NULLED = {
    "table": "events",
    "alias": "e",
    "columns": ["event_id", {"eql": "nullif(event_type, 'error')", "name": "kind"}, {"eql": "nullif(user_id, 8)", "name": "who"}],
}


@case(
    "q9_nulls",
    """select event_id, who from (select event_id, nullif(event_type, 'error') as kind, nullif(user_id, 8) as who from events)
       where kind is null and who is not null""",
)
def _(t):
    spec = {
        "table": "e",
        "subquery": _NULLED,
        "columns": ["event_id", "who"],
        "conditions": [
            {"type": "IS_NULL", "values": [_ref("kind")]},
            {"type": "IS_NOT_NULL", "values": [_ref("who")]},
        ],
    }
    return run_query(spec, t.named("events"))


@case(
    "q10_operands",
    """select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey
       where o_totalprice > c_acctbal and o_orderstatus = 'O'""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": ["o_orderkey", {"table": "customer", "column": "c_custkey"}],
        "joins": [{"table": "customer", "join_eql": "orders.o_custkey = customer.c_custkey"}],
        "conditions": [
            {"type": "GREATER_THAN", "values": [_ref("o_totalprice"), _ref("c_acctbal", "customer")]},
            {"type": "EQUALS", "values": [_ref("o_orderstatus"), _value("O")]},
        ],
    }
    return run_query(spec, t.named("orders", "customer"))


@case(
    "q11_expression_predicate",
    "select o_orderkey from orders where year(o_orderdate) > 1997 or o_totalprice < 1000 and o_orderstatus in ('F', 'P')",
)
def _(t):
    return _conditions(
        t, "orders", ["o_orderkey"],
        {"eql": "YEAR(o_orderdate) > 1997 || o_totalprice < 1000 && o_orderstatus in ('F', 'P')"},
    )


@case(
    "q12_conditions_are_anded",
    """select p_partkey, p_size::bigint as p_size from part where p_size > 10 and (p_brand = 'Brand#4' or p_type = 'PROMO') and p_name like '%ring%'""",
)
def _(t):
    return _conditions(
        t, "part", ["p_partkey", "p_size"],
        {"type": "GREATER_THAN", "values": [_ref("p_size"), _value(10)]},
        {"eql": "p_brand = 'Brand#4' or p_type = 'PROMO'"},
        {"type": "CONTAINS", "values": [_ref("p_name"), _value("ring")]},
    )


@case(
    "q13_keyed_lookup",
    """select c_custkey, c_name, c_mktsegment from customer
       where c_custkey in (select o_custkey from orders where o_totalprice > 400000) and c_acctbal > 0""",
)
def _(t):
    keys = t.orders.where("o_totalprice > 400000")
    return keyed_lookup(
        t.customer, keys, "o_custkey", ["c_custkey", "c_name", "c_mktsegment"], ["c_acctbal > 0"], "c_custkey"
    )


@case("q14_fetch_by_id", "select event_id, user_id, event_type from events")
def _(t):
    return fetch_by_id(t.events, "event_id").select("event_id", "user_id", "event_type")


# --- order, limit, top-k ---------------------------------------------------------------


@case(
    "o1_order_by",
    """select o_orderpriority, count(*) as orders, round(avg(o_totalprice), 4) as average from orders
       group by o_orderpriority order by count(*) desc, o_orderpriority""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": [
            "o_orderpriority",
            {"eql": "count(*)", "name": "orders"},
            {"eql": "round(avg(o_totalprice), 4)", "name": "average"},
        ],
        "groupBy": ["o_orderpriority"],
        "orderBy": [{"eql": "count(*)", "orderByDirection": "DESC"}, {"column": "o_orderpriority"}],
    }
    return run_query(spec, t.named("orders"))


_PAGE = {
    "table": "orders",
    "columns": ["o_orderkey", "o_totalprice"],
    "orderBy": [{"column": "o_totalprice", "orderByDirection": "desc"}, {"column": "o_orderkey"}],
    "limit": 25,
    "offset": 50,
}


@case("o2_limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def _(t):
    return run_query(_PAGE, t.named("orders"))


@case("o3_override_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
def _(t):
    return run_query(override_limit(_PAGE, 10, 5), t.named("orders"))


@case(
    "o4_top_groups_detail",
    """with big as (select l_suppkey from lineitem group by l_suppkey order by count(*) desc, l_suppkey limit 50)
       select l_suppkey, l_returnflag, count(*) as records, count(distinct l_partkey) as distinct_people
       from lineitem where l_suppkey in (select l_suppkey from big) group by l_suppkey, l_returnflag""",
)
def _(t):
    items = t.lineitem.withColumnRenamed("l_partkey", "person_id")
    largest = top_groups(items, "l_suppkey", 50)
    return stats_by_type(items.join(F.broadcast(largest), "l_suppkey", "left_semi"), "l_returnflag", ["l_suppkey"])


def _top_values(table, columns):
    return " union all ".join(
        f"""select '{c}' as name, string_agg(v, '|' order by n desc, v) as sample from
            (select cast({c} as varchar) as v, count(*) as n from {table} group by 1 order by n desc, v limit 32)"""
        for c in columns
    )


@case("o5_top_values_per_column", _top_values("part", ["p_name", "p_brand", "p_type", "p_size"]))
def _(t):
    found = profile(t.part.select("p_name", "p_brand", "p_type", "p_size"))
    return found.select("name", F.array_join("sample", "|").alias("sample"))


# --- set operations ----------------------------------------------------------------------

_ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_DESC = ", ".join(f"{c.strip()} desc" for c in _ALL.split(","))


@case(
    "e1_both_ends",
    f"""select l_returnflag, count(*) as records, cast(sum(cast(l_extendedprice as decimal(19,2))) as double) as total,
        min(l_orderkey) as first_key, max(l_orderkey) as last_key
        from ((select {_ALL} from lineitem order by {_ALL} limit 25000)
              union (select {_ALL} from lineitem order by {_DESC} limit 25000)) group by l_returnflag""",
)
def _(t):
    ends = both_ends(t.lineitem, [c.strip() for c in _ALL.split(",")])
    return ends.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("records"),
        money("l_extendedprice").alias("total"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
    )


@case(
    "e2_intersection",
    """select c_custkey as person_id from customer
       where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')
         and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
         and c_custkey in (select user_id from events where event_type = 'purchase')""",
)
def _(t):
    by = lambda test: t.orders.where(test).select(F.col("o_custkey").alias("person_id"))
    buyers = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("person_id"))
    return segment_people(
        t.customer, [by("o_orderstatus = 'F'"), by("o_orderpriority = '1-URGENT'"), buyers], key="c_custkey"
    )


@case(
    "e3_difference",
    """select c_custkey as person_id from customer
       where c_custkey not in (select o_custkey from orders where o_totalprice > 450000)
         and c_custkey not in (select user_id from events where event_type = 'error')""",
)
def _(t):
    rich = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("person_id"))
    failed = t.events.where("event_type = 'error'").select(F.col("user_id").alias("person_id"))
    return segment_people(t.customer, [], [rich, failed], key="c_custkey")


@case(
    "e4_new_rows",
    """select distinct o_custkey, o_orderstatus, o_orderpriority from orders where o_orderdate >= timestamp '1998-01-01'
       except select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderdate < timestamp '1998-01-01'""",
)
def _(t):
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    late = t.orders.where("o_orderdate >= '1998-01-01'").select(*columns)
    early = t.orders.where("o_orderdate < '1998-01-01'").select(*columns)
    return new_rows(late, early)


@case(
    "e4_new_rows_since",
    """select distinct o_custkey, o_orderstatus, o_orderpriority from orders where o_orderdate >= timestamp '1998-01-01'
       except select o_custkey, o_orderstatus, o_orderpriority from orders where o_orderdate < timestamp '1998-01-01'""",
)
def _(t):
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    path = scratch_path(t.spark, "hashes")
    # The history arrives in two parts, one of them twice; it is asked for by its hashes alone.
    for since, until in (("1990-01-01", "1995-01-01"), ("1994-01-01", "1998-01-01"), ("1990-01-01", "1995-01-01")):
        remember_rows(t.orders.where(f"o_orderdate >= '{since}' and o_orderdate < '{until}'").select(*columns), path, digits=1)
    return new_rows_since(t.orders.where("o_orderdate >= '1998-01-01'").select(*columns), path, digits=1)


@case(
    "o2_deep_page",
    """select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_extendedprice from lineitem
       order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 250
       offset (select count(*) * 5 // 6 from lineitem)""",
)
def _(t):
    spec = {
        "table": "lineitem",
        "columns": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        "orderBy": [{"eql": "l_extendedprice", "orderByDirection": "desc"}, "l_orderkey", "l_linenumber", "l_partkey", {"eql": "l_suppkey"}],
        "limit": 250,
        "offset": t.lineitem.count() * 5 // 6,
    }
    return plain(run_query(spec, t.named("lineitem")))
