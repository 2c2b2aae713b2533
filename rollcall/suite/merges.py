"""Upserts, inserts, de-duplication, views (U, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import merge as m
from rollcall.operators.chain import map_files
from rollcall.functions.dates import week
from rollcall.session import scratch_path
from rollcall.suite import case, money, plain

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def versions(t):
    """What line items say about their orders: many rows per order, the dearest item counts."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"), "l_partkey", "l_suppkey", F.lit("x").alias("not_in_target"),
    )


_LATEST = """(select l_orderkey, l_linestatus, l_extendedprice from (select *, row_number() over (partition by l_orderkey
    order by l_extendedprice desc, l_partkey desc, l_suppkey desc, l_linestatus desc) as rn from lineitem) where rn = 1)"""


@case(
    "u1_upsert",
    f"""select coalesce(o_orderkey, l_orderkey) as o_orderkey, o_custkey, coalesce(l_linestatus, o_orderstatus) as o_orderstatus,
        coalesce(l_extendedprice, o_totalprice) as o_totalprice
        from (select * from orders where o_orderstatus <> 'P') full join {_LATEST} on o_orderkey = l_orderkey""",
)
def _(t):
    target = t.orders.where("o_orderstatus <> 'P'").select(*_COLUMNS)
    return m.upsert(target, versions(t), ["o_orderkey"], ["o_totalprice", "l_partkey", "l_suppkey"])


@case(
    "u2_insert_ignore",
    f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'P'
        union all select l_orderkey, null, l_linestatus, l_extendedprice from {_LATEST}
        where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""",
)
def _(t):
    target = t.orders.where("o_orderstatus <> 'P'").select(*_COLUMNS)
    incoming = m.keep_latest(versions(t), ["o_orderkey"], ["o_totalprice", "l_partkey", "l_suppkey"])
    return m.insert_ignore(target, incoming, ["o_orderkey"])


@case(
    "u3_upsert_many",
    """select 'customer' as name, count(*) as records, cast(sum(case when c_acctbal < 0 then 0 else cast(c_acctbal as decimal(19,2)) end) as double) as total from customer
       union all select 'supplier', count(*), cast(sum(case when s_acctbal < 0 then 0 else cast(s_acctbal as decimal(19,2)) end) as double) from supplier""",
)
def _(t):
    targets = {"customer": t.customer, "supplier": t.supplier}
    incoming = {
        "customer": t.customer.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")),
        "supplier": t.supplier.where("s_acctbal < 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")),
    }
    out = m.upsert_many(targets, incoming, {"customer": ["c_custkey"], "supplier": ["s_suppkey"]})
    sums = [
        out[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("records"), money(column).alias("total"))
        for name, column in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))
    ]
    return sums[0].unionByName(sums[1])


@case(
    "u4_keep_latest",
    """select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""",
)
def _(t):
    latest = m.keep_latest(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@case(
    "u5_new_rows_by_key",
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn
       from orders where o_orderdate >= timestamp '1999-06-01') where rn = 1
       and o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1999-06-01' and o_totalprice > 300000)""",
)
def _(t):
    late = t.orders.where("o_orderdate >= '1999-06-01'")
    early = t.orders.where("o_orderdate < '1999-06-01' and o_totalprice > 300000")
    found = m.new_rows(late, early, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return found.select("o_custkey", "o_orderkey", "o_totalprice")


@case(
    "u6_map_files",
    """select c_custkey::varchar as key, upper(c_name) as name, c_mktsegment as segment, 'mapped' as state from customer""",
)
def _(t):
    def renamed(df):
        return df.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))

    def louder(df):
        return df.withColumn("name", F.upper("name"))

    def marked(df):
        return df.withColumn("state", F.lit("mapped"))

    return map_files(t.customer, scratch_path(t.spark, "mapped"), renamed, louder, marked, gzip=True)


@case(
    "u1_upsert_files",
    """select cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as int) as varchar) as week, count(*) as orders,
       cast(sum(case when o_orderdate >= timestamp '2001-01-01' then 1 else cast(o_totalprice as decimal(19,2)) end) as double) as total
       from orders group by 1""",
)
def _(t):
    path = scratch_path(t.spark, "orders")
    rows = t.orders.withColumn("week", week("o_orderdate").cast("string"))
    m.upsert_files(path, rows.where("o_orderstatus <> 'P'"), ["week", "o_orderkey"], F.substring("week", 1, 4))
    late = rows.where("o_orderdate >= '2001-01-01'").withColumn("o_totalprice", F.lit(1.0))
    m.upsert_files(path, rows.where("o_orderstatus = 'P'").unionByName(late.where("o_orderstatus <> 'P'")), ["week", "o_orderkey"], F.substring("week", 1, 4))
    m.upsert_files(path, late, ["week", "o_orderkey"], F.substring("week", 1, 4))
    return t.spark.read.parquet(path).groupBy("week").agg(F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("total"))


@case("v1_ensure_view", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    m.ensure_view("nation_region", joined.select("n_name", "r_name"), replace=True)
    return plain(m.ensure_view("nation_region", joined.select("n_name")))
