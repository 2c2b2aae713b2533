"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators.resources import attach_children
from rollcall.operators.segments import segment_people
from rollcall.operators.timeline import append_dictionary_id, timeline_detail_summary
from rollcall.plans.ranges import range_join
from rollcall.plans.query import run_query
from rollcall.suite import case, plain


@case(
    "j1_inner",
    """select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": ["o_orderkey", {"eql": "c.c_name", "name": "c_name"}, {"table": "c", "column": "c_mktsegment"}],
        "joins": [{"table": "customer", "alias": "c", "join_eql": "orders.o_custkey = c.c_custkey"}],
    }
    return run_query(spec, t.named("orders", "customer"))


def _two_sided(t, kind):
    spec = {
        "table": "customer",
        "columns": ["c_custkey", {"eql": "events.event_id", "name": "event_id"}],
        "joins": [
            {
                "table": "events",
                "type": kind,
                "join_eql": "customer.c_custkey = events.user_id + 100 and events.event_type = 'signup'",
            }
        ],
    }
    return run_query(spec, t.named("customer", "events"))


_ON = "on c_custkey = user_id + 100 and event_type = 'signup'"


@case("j2_left", f"select c_custkey, event_id from customer left join events {_ON}")
def _(t):
    return _two_sided(t, "left")


@case("j2_right", f"select c_custkey, event_id from customer right join events {_ON}")
def _(t):
    return _two_sided(t, "right")


@case("j3_outer", f"select c_custkey, event_id from customer full join events {_ON}")
def _(t):
    return _two_sided(t, "outer")


@case(
    "j4_same_table_twice",
    """select cn.n_regionkey::bigint as buyer_region, sn.n_regionkey::bigint as seller_region, count(*) as items,
       count(distinct o_orderkey) as orders
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join supplier on l_suppkey = s_suppkey join nation cn on c_nationkey = cn.n_nationkey
       join nation sn on s_nationkey = sn.n_nationkey group by 1, 2""",
)
def _(t):
    spec = {
        "table": "lineitem",
        "columns": [
            {"eql": "cn.n_regionkey", "name": "buyer_region"},
            {"eql": "sn.n_regionkey", "name": "seller_region"},
            {"eql": "count(*)", "name": "items"},
            {"eql": "count(distinct orders.o_orderkey)", "name": "orders"},
        ],
        "joins": [
            {"table": "orders", "join_eql": "lineitem.l_orderkey = orders.o_orderkey"},
            {"table": "customer", "join_eql": "orders.o_custkey = customer.c_custkey"},
            {"table": "supplier", "join_eql": "lineitem.l_suppkey = supplier.s_suppkey"},
            {"table": "nation", "alias": "cn", "join_eql": "customer.c_nationkey = cn.n_nationkey"},
            {"table": "nation", "alias": "sn", "join_eql": "supplier.s_nationkey = sn.n_nationkey"},
        ],
        "groupBy": [{"eql": "cn.n_regionkey"}, {"eql": "sn.n_regionkey"}],
    }
    return plain(run_query(spec, t.named("lineitem", "orders", "customer", "supplier", "nation")))


@case(
    "j5_theta",
    """select o_orderkey, l_partkey, l_linenumber::bigint as l_linenumber from orders left join lineitem
       on o_orderkey = l_orderkey and l_extendedprice > o_totalprice / 4 and l_returnflag = 'R' where o_orderstatus = 'P'""",
)
def _(t):
    spec = {
        "table": "orders",
        "columns": ["o_orderkey", {"table": "lineitem", "column": "l_partkey"}, {"table": "lineitem", "column": "l_linenumber"}],
        "joins": [
            {
                "table": "lineitem",
                "type": "left",
                "join_eql": "orders.o_orderkey = lineitem.l_orderkey and lineitem.l_extendedprice > orders.o_totalprice / 4"
                " and lineitem.l_returnflag = 'R'",
            }
        ],
        "conditions": [{"eql": "orders.o_orderstatus = 'P'"}],
    }
    return plain(run_query(spec, t.named("orders", "lineitem")))


@case(
    "j5_range",
    """select p_partkey, count(*) as items, cast(sum(l_quantity) as bigint) as quantity, min(l_orderkey) as first_order from lineitem join part
       on l_extendedprice between p_retailprice * 10 and p_retailprice * 10 + p_size * p_size * 4 group by 1""",
)
def _(t):
    # A pure range condition: intervals from 4 to 10,000 wide, no equality.
    spec = {
        "table": "lineitem",
        "columns": [
            {"table": "part", "column": "p_partkey"}, {"eql": "count(*)", "name": "items"}, {"eql": "cast(sum(l_quantity) as signed)", "name": "quantity"},
            {"eql": "min(l_orderkey)", "name": "first_order"},
        ],
        "joins": [{
            "table": "part",
            "range": {"value": "lineitem.l_extendedprice", "low": "part.p_retailprice * 10", "high": "part.p_retailprice * 10 + part.p_size * part.p_size * 4"},
        }],
        "groupBy": [{"table": "part", "column": "p_partkey"}],
    }
    return plain(run_query(spec, t.named("lineitem", "part")))


@case(
    "j5_range_left",
    """select o_orderkey, count(event_id) as events, min(event_id) as first_event from orders left join events
       on ts >= o_orderdate + interval 27 year and ts < o_orderdate + interval 27 year + interval (o_custkey % 5) hour where o_orderkey % 4 = 0 group by 1""",
)
def _(t):
    # Intervals on the left of the question, so events are the values and orders without any come back by their key.
    spans = t.orders.where("o_orderkey % 4 = 0").selectExpr(
        "o_orderkey", "o_orderdate + interval 27 year as opens", "o_orderdate + interval 27 year + make_interval(0, 0, 0, 0, cast(o_custkey % 5 as int)) as closes"
    )
    pairs = range_join(t.events.select("event_id", "ts"), spans, "ts", "opens", "closes", F.col("ts") < F.col("closes"))
    counted = pairs.groupBy("o_orderkey").agg(F.count("event_id").alias("events"), F.min("event_id").alias("first_event"))
    return spans.select("o_orderkey").join(counted, "o_orderkey", "left").withColumn("events", F.coalesce("events", F.lit(0)))


@case("j6_semi", "select c_custkey as person_id from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def _(t):
    part = {
        "table": "orders",
        "columns": [{"eql": "o_custkey", "name": "person_id"}],
        "conditions": [{"eql": "o_totalprice > 300000"}],
    }
    return segment_people(t.customer, [part], [], t.named("orders"), "c_custkey")


@case(
    "j7_anti_with_nulls",
    """select c_custkey as person_id from customer where not exists
       (select 1 from orders where nullif(o_custkey, 10) = c_custkey and o_orderstatus = 'F')""",
)
def _(t):
    part = {
        "table": "orders",
        "columns": [{"eql": "nullif(o_custkey, 10)", "name": "person_id"}],
        "conditions": [{"eql": "o_orderstatus = 'F'"}],
    }
    return segment_people(t.customer, [], [part], t.named("orders"), "c_custkey")


KINDS = {"click": 1, "signup": 2, "view": 3, "purchase": 4}


@case(
    "j8_provenance_star",
    """select e.event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
       case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 3 when 'purchase' then 4 else 9 end::bigint as entry_type_id,
       case event_type when 'error' then 'N/A' else event_type end as entry_type,
       user_id as person_id, n_nationkey::bigint as input_id, n_name as remote_input_name, r_name as plugin_name,
       s.source_code_id::bigint as source_code_id, s.source_code, e.value, e.props
       from events e join nation on n_nationkey = user_id % 20 join region on n_regionkey = r_regionkey
       left join (select distinct p_size as source_code_id, 'code-' || p_size as source_code from part where p_size > 10) s
         on s.source_code_id = event_id % 50""",
)
def _(t):
    details = t.events.select(F.col("event_id").alias("id"), "value", "props")
    code = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    timeline = t.events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.coalesce(code[F.col("event_type")], F.lit(9)).alias("entry_type_id"),
        (F.col("event_id") % 50).alias("source_code_id"),
        (F.col("user_id") % 20).alias("input_id"),
        F.col("user_id").alias("person_id"),
    )
    inputs = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("plugin_id"), F.col("n_name").alias("remote_input_name")
    )
    plugins = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    dictionary = (
        t.part.where("p_size > 10")
        .select(F.col("p_size").alias("source_code_id"), F.concat(F.lit("code-"), F.col("p_size").cast("string")).alias("source_code"))
        .distinct()
    )
    return plain(timeline_detail_summary(details, timeline, inputs, plugins, dictionary, KINDS))


@case(
    "j9_attach_children",
    """select c_custkey, coalesce(o.n, 0) as orders, coalesce(o.ids, '') as order_ids, coalesce(e.n, 0) as events, coalesce(e.ids, '') as event_ids
       from customer
       left join (select o_custkey, count(*) as n, string_agg('order:' || o_orderkey, ',' order by o_orderkey) as ids from orders group by 1) o on o_custkey = c_custkey
       left join (select user_id, count(*) as n, string_agg('event:' || event_id, ',' order by event_id) as ids from events group by 1) e on user_id = c_custkey""",
)
def _(t):
    found = attach_children(
        t.customer.select("c_custkey"),
        "c_custkey",
        {
            "orders": {"children": t.orders, "foreign_key": "o_custkey", "id": "o_orderkey", "type": "order"},
            "events": {"children": t.events, "foreign_key": "user_id", "id": "event_id", "type": "event"},
        },
    )

    def listed(name):
        return F.array_join(F.transform(name, lambda x: F.concat(x["type"], F.lit(":"), x["id"].cast("string"))), ",")

    return found.select(
        "c_custkey",
        F.size("orders").cast("bigint").alias("orders"),
        listed("orders").alias("order_ids"),
        F.size("events").cast("bigint").alias("events"),
        listed("events").alias("event_ids"),
    )


@case(
    "j10_dimension_lookup",
    """select o_orderkey, case when o_orderkey % 10 = 0 then 0 when o_orderpriority = '5-LOW' then 5 else left(o_orderpriority, 1)::bigint end as priority_id from orders""",
)
def _(t):
    # Spellings vary and some are blank; one value is not in the dimension yet and gets the next number.
    known = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("priority")).distinct()
    dimension = known.withColumn("id", F.substring("priority", 1, 1).cast("bigint"))
    typed = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(typed).alias("priority"))
    found, _ = append_dictionary_id(rows, dimension, "priority", "priority_id", order=["o_orderkey"])
    return found.select("o_orderkey", F.col("priority_id").cast("bigint").alias("priority_id"))
