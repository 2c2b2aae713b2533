"""Cleaning and conforming (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.text import normalize_lookup
from rollcall.operators.clean import coerce, conform, drift, missing_report, with_defaults
from rollcall.operators.timeline import entry_hex, uuid_of
from rollcall.suite import case, plain


def raw_orders(t):
    """Orders the way they arrive in a file: text, with blanks, NULLs, currency signs and junk."""
    key = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    return t.orders.select(
        "o_orderkey",
        F.when(key % 11 == 0, "").when(key % 13 == 0, "NULL").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 7 == 0, "none").when(key % 17 == 0, "").otherwise(F.concat(F.lit("$"), price)).alias("amount"),
        F.when(key % 3 == 0, "yes").when(key % 3 == 1, "no").otherwise("1").alias("flag"),
        F.when(key % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("ordered"),
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("note"),
        "o_orderstatus",
    )


@case(
    "c1_coerce",
    """select o_orderkey, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else o_custkey end as customer,
       case when o_orderkey % 7 = 0 then 0.0 when o_orderkey % 17 = 0 then null else o_totalprice end::double as amount,
       o_orderkey % 3 <> 1 as flag,
       case when o_orderkey % 5 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as ordered,
       left(o_orderpriority || ' ' || o_orderstatus, 8) as note,
       case when o_orderstatus in ('F', 'O') then o_orderstatus end as status from orders""",
)
def _(t):
    schema = {
        "customer": "bigint",
        "amount": "currency",
        "flag": "boolean",
        "ordered": "date",
        "note": {"type": "text", "length": 8},
        "status": {"type": "enum", "values": ["F", "O"]},
    }
    return plain(coerce(raw_orders(t).withColumnRenamed("o_orderstatus", "status"), schema, policy="cut"))


@case(
    "c2_over_length",
    """select p_partkey, left(p_name, 6) as cut, p_name as kept, p_name as checked from part""",
)
def _(t):
    names = t.part.select("p_partkey", *[F.col("p_name").alias(c) for c in ("cut", "kept", "checked")])
    cut = coerce(names, {"cut": {"type": "text", "length": 6}}, "cut")
    kept = coerce(cut, {"kept": {"type": "text", "length": 6}}, "keep")
    return coerce(kept, {"checked": {"type": "text", "length": 255}}, "fail")


@case(
    "c3_defaults",
    """select event_id, coalesce(nullif(case when event_type = 'view' then '' when event_type = 'click' then null else event_type end, ''), 'other') as kind,
       case when coalesce(nullif(user_id, 8), 0) = 0 then 999 else user_id end as who, 'web' as channel from events""",
)
def _(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type")).alias("kind"),
        F.nullif("user_id", F.lit(8)).alias("who"),
    )
    return with_defaults(rows, {"kind": "other", "who": 999, "channel": "web"})


DECLARED = {
    "o_orderkey": "id",
    "customer": "person_id",
    "amount": "currency",
    "flag": "boolean",
    "remote_id": "id_string",
    "referrer": "url",
    "score": {"type": "int", "default": 7},
}


@case(
    "c4_conform",
    """select o_orderkey, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 0 else o_custkey end as customer,
       case when o_orderkey % 7 = 0 then 0.0 when o_orderkey % 17 = 0 then null else o_totalprice end::double as amount,
       o_orderkey % 3 <> 1 as flag, '' as remote_id, cast(null as varchar) as referrer, 7::bigint as score from orders""",
)
def _(t):
    return plain(conform(raw_orders(t), DECLARED))


_COUNTS = """select count(*) filter (o_orderkey % 11 = 0 or o_orderkey % 13 = 0) as c_blank,
    count(*) filter (o_orderkey % 7 <> 0 and o_orderkey % 17 = 0) as a_blank, count(*) filter (o_orderkey % 7 = 0) as a_lost from orders"""


@case(
    "c4_drift_report",
    f"""with n as ({_COUNTS})
        select 'o_orderkey' as "column", 'bigint' as declared, 'bigint' as actual, 'same' as state, 0::bigint as blanks, 0::bigint as rejected from n
        union all select 'customer', 'bigint', 'string', 'type', c_blank, 0 from n
        union all select 'amount', 'decimal(19,2)', 'string', 'type', a_blank, a_lost from n
        union all select 'flag', 'boolean', 'string', 'type', 0, 0 from n
        union all select 'remote_id', 'string', null, 'missing', null, null from n
        union all select 'referrer', 'string', null, 'missing', null, null from n
        union all select 'score', 'int', null, 'missing', null, null from n
        union all select 'note', null, 'string', 'undeclared', 0, 0 from n""",
)
def _(t):
    return drift(raw_orders(t).drop("ordered", "o_orderstatus"), DECLARED)


@case(
    "c5_required_columns",
    """select count(*) as records, count(*) filter (event_id % 10 = 0) as bad_ids, 0::bigint as missing_id, 0::bigint as missing_ts,
       count(*) filter (user_id = 8) as missing_person_id, 0::bigint as missing_entry_type_id, count(*) filter (event_type = 'view') as missing_source_code_id from events""",
)
def _(t):
    digits = entry_hex(F.unix_millis("ts"), F.col("event_id"))
    rows = t.events.withColumn("_hex", digits).select(
        F.when(F.col("event_id") % 10 == 0, F.col("event_id").cast("string"))
        .otherwise(uuid_of("_hex"))
        .alias("id"),
        "ts",
        F.nullif("user_id", F.lit(8)).alias("person_id"),
        F.lit(1).alias("entry_type_id"),
        F.nullif("event_type", F.lit("view")).alias("source_code_id"),
    )
    return missing_report(rows)


@case("c6_normalize_lookup", "select p_partkey, lower(trim('  ' || upper(p_name) || ' ')) as name from part")
def _(t):
    return t.part.select("p_partkey", normalize_lookup(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("name"))
