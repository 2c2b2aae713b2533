"""Transform chains and their bindings (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import chain as ch
from rollcall.operators.identity import custom_fields
from rollcall.operators.merge import upsert
from rollcall.suite import case, money, plain
from rollcall.suite.timelines import TYPES, entries


@case(
    "f1_chain",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') as ordered_on, lower(o_orderpriority) || '.org' as email_domain,
       o_totalprice as amount from orders""",
)
def _(t):
    raw = t.orders.select(
        F.col("o_orderkey"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("Ordered On"),
        F.concat(F.lit("a@"), "o_orderpriority", F.lit(".org")).alias("Email"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Amount"),
    )
    steps = [
        "clean_columns",
        {"transform": "clean_date", "options": {"field": "ordered_on"}},
        "email_domain",
        {"transform": "coerce", "options": {"schema": {"amount": "currency"}}},
        lambda df: df.drop("email"),
    ]
    return plain(ch.run_chain(raw, steps).rows)


@case(
    "f2_bound_lookup",
    """select event_id, user_id, c_name, c_mktsegment from events left join (select * from customer where c_acctbal > 0) on c_custkey = user_id""",
)
def _(t):
    def named(rows, people):
        return rows.join(people, rows["user_id"] == people["c_custkey"], "left").drop("c_custkey")

    step = {
        "transform": named,
        "bindings": {
            "people": {
                "type": "sql.query", "table": "customer", "key": "user_id", "foreign_key": "c_custkey",
                "columns": ["c_custkey", "c_name", "c_mktsegment"], "conditions": ["c_acctbal > 0"],
            }
        },
    }
    return ch.run_chain(t.events.select("event_id", "user_id"), [step], t.named("customer")).rows


@case(
    "f3_table_upserts",
    """select c_custkey, coalesce(t.total, c_acctbal) as c_acctbal, c_name from customer
       left join (select o_custkey, cast(sum(cast(o_totalprice as decimal(19,2))) as double) as total from orders where o_orderstatus = 'F' group by 1) t on o_custkey = c_custkey""",
)
def _(t):
    def totals(rows):
        spent = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(money("o_totalprice").alias("c_acctbal"))
        return ch.Outputs(rows, tables={"customer": spent})

    result = ch.run_chain(t.orders.where("o_orderstatus = 'F'"), [totals])
    people = t.customer.select("c_custkey", "c_acctbal", "c_name")
    # Orders may name customers that are not on file; those are added by the upsert.
    stored, _ = ch.store(result, {"customer": people}, {"customer": ["c_custkey"]})
    return stored["customer"].join(people.select("c_custkey"), "c_custkey", "left_semi")


@case(
    "f4_timeline_output",
    """select case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 3 when 'purchase' then 4 else 5 end::bigint as entry_type_id,
       count(*) as records, count(distinct user_id) as people from events where value > 25 or event_type = 'purchase' group by 1""",
)
def _(t):
    columns = ["id", "ts", "person_id", "entry_type_id", "source_code_id"]

    def noteworthy(rows):
        return ch.Outputs(rows, timeline=rows.where("value > 25").select(*columns))

    rows = entries(t)
    result = ch.run_chain(rows, [noteworthy])
    stored = rows.where(F.col("entry_type_id") == TYPES["purchase"]).select(*columns)
    _, timeline = ch.store(result, {}, {}, stored)
    return plain(timeline.groupBy("entry_type_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("person_id").alias("people")))


@case(
    "f5_custom_fields",
    """select c_custkey as person_id, c_mktsegment as segment, c_acctbal as balance, case when c_acctbal < 0 then 'kept' end as note from customer
       where c_mktsegment <> 'BUILDING' or c_acctbal > 0 or c_acctbal < 0""",
)
def _(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("person_id"),
        "c_name",
        F.col("c_mktsegment").alias("custom.segment"),
        F.col("c_acctbal").alias("custom.balance"),
        F.lit("x").alias("other.field"),
    )
    fields = custom_fields(rows, "custom")
    stored = t.customer.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("person_id"), F.lit("old").alias("segment"), F.lit(0.0).alias("balance"), F.lit("kept").alias("note")
    )
    return upsert(stored, fields, ["person_id"])
