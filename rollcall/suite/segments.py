"""Segments, exports, resource queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import segments as s
from rollcall.operators.resources import resource_query
from rollcall.suite import case

INCLUDE = [
    {
        "table": "orders",
        "columns": [{"eql": "o_custkey", "name": "person_id"}],
        "conditions": [{"eql": "YEAR(o_orderdate) >= 1998"}],
        "groupBy": [{"eql": "o_custkey"}],
        "having": [{"eql": "count(*) > 3"}],
    },
    {
        "table": "nation",
        "columns": [{"eql": "customer.c_custkey", "name": "person_id"}],
        "joins": [{"table": "customer", "join_eql": "nation.n_nationkey = customer.c_nationkey"}],
        "conditions": [{"type": "LESS_THAN", "values": [{"ref": {"column": "n_regionkey"}}, {"value": {"value": 4}}]}],
    },
]
EXCLUDE = [{"table": "events", "columns": [{"eql": "user_id", "name": "person_id"}], "conditions": [{"eql": "event_type = 'error' and value > 90"}]}]

_MEMBERS = """select c_custkey as person_id from customer
    where c_custkey in (select o_custkey from orders where year(o_orderdate) >= 1998 group by 1 having count(*) > 3)
      and c_custkey in (select c_custkey from nation join customer on n_nationkey = c_nationkey where n_regionkey < 4)
      and c_custkey not in (select user_id from events where event_type = 'error' and value > 90)"""


def members(t):
    return s.segment_people(t.customer, INCLUDE, EXCLUDE, t.named("orders", "nation", "customer", "events"), "c_custkey")


@case("b1_segment_people", _MEMBERS)
def _(t):
    return members(t)


@case("b2_segment_count", f"select count(*) as people from ({_MEMBERS})")
def _(t):
    return s.segment_count(members(t))


@case(
    "b3_build_segment",
    f"""select segment_id, person_id from (select 'loyal' as segment_id, person_id from ({_MEMBERS})
        union select 'loyal', c_custkey from customer where c_acctbal > 9000 union select 'rich', c_custkey from customer where c_acctbal > 9000)""",
)
def _(t):
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("person_id"))
    table, _ = s.build_segment("rich", rich)
    table, _ = s.build_segment("loyal", rich, table)
    table, _ = s.build_segment("loyal", members(t), table)
    return table


@case(
    "b4_segment_sample",
    f"select c_custkey, c_name from customer where c_custkey in (select person_id from ({_MEMBERS})) order by c_custkey limit 10",
)
def _(t):
    return s.segment_sample(members(t), t.customer, "c_custkey", ["c_name"])


@case(
    "b5_segment_stats",
    f"select 'loyal' as segment_id, count(*) as people from ({_MEMBERS}) union all select 'rich', count(*) from customer where c_acctbal > 9000",
)
def _(t):
    table, _ = s.build_segment("rich", t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("person_id")))
    table, _ = s.build_segment("loyal", members(t), table)
    return s.segment_stats(table)


RULES = {
    "combinator": "and",
    "rules": [
        {"field": "c_mktsegment", "operator": "beginsWith", "value": "B"},
        {
            "combinator": "or",
            "rules": [
                {"field": "c_nationkey", "operator": "=", "value": 3},
                {"field": "c_acctbal", "operator": ">", "value": 5000},
            ],
        },
        {"combinator": "or", "not": True, "rules": [{"field": "c_nationkey", "operator": "in", "value": [7, 8, 9]}]},
    ],
}


@case(
    "b6_rules_to_predicate",
    """select c_custkey, c_mktsegment from customer where starts_with(c_mktsegment, 'B') and (c_nationkey = 3 or c_acctbal > 5000)
       and not (c_nationkey in (7, 8, 9))""",
)
def _(t):
    return t.customer.where(s.rules_to_predicate(RULES)).select("c_custkey", "c_mktsegment")


def export(t, chunk_rows=None):
    orders = t.orders.select(F.col("o_custkey").alias("person_id"), "o_orderkey", "o_orderstatus", "o_totalprice")
    events = t.events.select(F.col("user_id").alias("person_id"), "event_id", "event_type")
    bindings = {
        "orders": {"table": "orders", "columns": ["o_orderkey", "o_orderstatus"], "conditions": ["o_totalprice > 1000"]},
        "events": events,
    }
    more = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    return s.export_people(members(t), bindings, {"orders": orders}, **more)


_EXPORT = f"""select person_id, o.n as orders, o.ids as order_ids, e.n as events, e.ids as event_ids from ({_MEMBERS})
    left join (select o_custkey, count(*) as n, string_agg(o_orderkey || o_orderstatus, ',' order by o_orderkey) as ids from orders where o_totalprice > 1000 group by 1) o on o_custkey = person_id
    left join (select user_id, count(*) as n, string_agg(event_id || event_type, ',' order by event_id) as ids from events group by 1) e on user_id = person_id"""


def _listed(name, *fields):
    return F.array_join(F.transform(name, lambda x: F.concat(*[x[f].cast("string") for f in fields])), ",")


@case("b7_export_people", _EXPORT)
def _(t):
    return export(t).select(
        "person_id",
        F.when(F.col("orders").isNotNull(), F.size("orders")).cast("bigint").alias("orders"),
        _listed("orders", "o_orderkey", "o_orderstatus").alias("order_ids"),
        F.when(F.col("events").isNotNull(), F.size("events")).cast("bigint").alias("events"),
        _listed("events", "event_id", "event_type").alias("event_ids"),
    )


# The same export with people of more than eight rows continued over several lines:
# put together again it must hold exactly the same rows.
@case(
    "b7_export_people_in_parts",
    f"""select person_id, 'order' as kind, o_orderkey as id from ({_MEMBERS}) join orders on o_custkey = person_id and o_totalprice > 1000
        union all select person_id, 'event', event_id from ({_MEMBERS}) join events on user_id = person_id""",
)
def _(t):
    parts = export(t, chunk_rows=8)
    orders = parts.select("person_id", F.lit("order").alias("kind"), F.explode("orders.o_orderkey").alias("id"))
    return orders.unionByName(parts.select("person_id", F.lit("event").alias("kind"), F.explode("events.event_id").alias("id")))


_PAGE = "(select * from customer order by c_custkey limit 100)"


@case(
    "b8_resource_query",
    f"""select 'customer' as type, c_custkey as id, c_name as name, c_acctbal as balance, n as orders, ids as order_ids from {_PAGE}
        left join (select o_custkey, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as ids from
          (select * from orders where o_custkey in (select c_custkey from {_PAGE})) group by 1) on o_custkey = c_custkey""",
)
def _(t):
    data, _ = resource_query(
        t.customer, "customer", "c_custkey", {"orders": {"children": t.orders, "foreign_key": "o_custkey", "id": "o_orderkey", "type": "order"}}
    )
    orders = F.col("relationships.orders")
    return data.select(
        "type",
        "id",
        F.col("attributes.c_name").alias("name"),
        F.col("attributes.c_acctbal").alias("balance"),
        F.nullif(F.size(orders), F.lit(0)).cast("bigint").alias("orders"),
        F.nullif(_listed(orders, "id"), F.lit("")).alias("order_ids"),
    )


@case(
    "b8_resource_included",
    f"""select 'order' as type, o_orderkey as id, o_orderstatus as status from orders
        where o_custkey in (select c_custkey from {_PAGE})""",
)
def _(t):
    _, included = resource_query(
        t.customer, "customer", "c_custkey", {"orders": {"children": t.orders, "foreign_key": "o_custkey", "id": "o_orderkey", "type": "order"}}
    )
    return included.select("type", "id", F.get_json_object("attributes", "$.o_orderstatus").alias("status"))


@case(
    "b9_export_delta",
    f"""select person_id, n from (select person_id, count(o_orderkey) as n, count(o_orderkey) filter (o_orderdate < timestamp '2001-01-01') as before
        from ({_MEMBERS}) left join orders on o_custkey = person_id group by 1) where n <> before""",
)
def _(t):
    def exported(orders):
        rows = orders.select(F.col("o_custkey").alias("person_id"), "o_orderkey", "o_totalprice")
        return s.export_people(members(t), {"orders": rows})

    changed = s.export_delta(exported(t.orders), exported(t.orders.where("o_orderdate < '2001-01-01'")))
    return changed.select("person_id", F.size("orders").cast("bigint").alias("n"))
