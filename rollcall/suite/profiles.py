"""Profiling (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators.profile import infer_types, profile, profile_table, suggest_storage
from rollcall.operators.timeline import entry_hex, uuid_of
from rollcall.suite import case, plain


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        text = kind == "string"
        low, high = (f"min({name})", f"max({name})")
        lengths = (f"min(length({name}))", f"max(length({name}))") if text else ("null", "null")
        parts.append(
            f"""select '{name}' as name, '{kind}' as type, count(*) as records, count(*) - count({name}) as empty,
            cast({low} as varchar) as min, cast({high} as varchar) as max, {lengths[0]}::bigint as min_length, {lengths[1]}::bigint as max_length,
            count(distinct {name}) as "distinct",
            (select string_agg(v, '|' order by n desc, v) from (select cast({name} as varchar) as v, count(*) as n from {table}
             where {name} is not null group by 1 order by n desc, v limit 32)) as sample from {table}"""
        )
    return " union all ".join(parts)


PART = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@case("p1_profile", _profile_sql("part", PART))
def _(t):
    return plain(profile(t.part).drop("position").withColumn("sample", F.array_join("sample", "|")))


DOCUMENT = {"text": "string", "lang": "string", "source": "string", "n_chars": "int", "label": "string"}


@case(
    "p1_profile_long_texts",
    "with d as (select text, lang, source, n_chars, left(text, 3) || doc_id // 2 as label from documents) " + _profile_sql("d", DOCUMENT),
)
def _(t):
    # Long texts, a few of them repeated, and a column whose values tie in their hundreds.
    rows = t.documents.select("text", "lang", "source", "n_chars", F.concat(F.substring("text", 1, 3), F.floor(F.col("doc_id") / 2).cast("string")).alias("label"))
    return plain(profile(rows).drop("position").withColumn("sample", F.array_join("sample", "|")))


@case(
    "p2_infer_types",
    """select * from (values ('key', 'int'), ('day', 'date'), ('moment', 'datetime'), ('amount', 'double'), ('paid', 'decimal'),
       ('status', 'string'), ('id', 'uuid'), ('mixed', 'string'), ('gaps', 'int'), ('nothing', 'string')) v(name, type)
       where (select count(*) from orders) > 0""",
)
def _(t):
    key = F.col("o_orderkey")
    raw = t.orders.withColumn("_hex", entry_hex(F.unix_millis("o_orderdate"), key)).select(
        key.cast("string").alias("key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format(F.col("o_orderdate") + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("moment"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.col("o_totalprice").cast("string").alias("paid"),
        F.col("o_orderstatus").alias("status"),
        uuid_of("_hex").alias("id"),
        F.when(key % 2 == 0, key.cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
        F.when(key % 2 == 0, key.cast("string")).alias("gaps"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return infer_types(raw, {"paid": "decimal"}).select("name", "type")


SUPPLIER = {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}


@case("p3_profile_table", _profile_sql("supplier", SUPPLIER))
def _(t):
    found = profile_table(t.supplier)
    return plain(found.drop("position").withColumn("sample", F.array_join("sample", "|")))


@case(
    "p4_suggest_storage",
    """select * from (values
       ('event_id', case when (select max(event_id) from events) <= 255 then 'UInt8' when (select max(event_id) from events) <= 65535 then 'UInt16' else 'UInt32' end,
        case when (select max(event_id) from events) <= 255 then 'smallint' when (select max(event_id) from events) <= 65535 then 'int' else 'bigint' end, false, '0'),
       ('ts', 'DateTime', 'timestamp', false, '1970-01-01 00:00:00'),
       ('offset_value', case when (select max(user_id) from events) <= 255 then 'Int8' else 'Int16' end,
        case when (select max(user_id) from events) <= 255 then 'tinyint' else 'smallint' end, false, '0'),
       ('event_type', 'LowCardinality(String)', 'string', true, ''),
       ('value', 'Decimal(19,4)', 'decimal(19,4)', false, '0'),
       ('amount', 'Decimal(19,2)', 'decimal(19,2)', false, '0')) v(name, storage, spark_type, low_cardinality, blank)""",
)
def _(t):
    rows = t.events.select(
        "event_id", "ts", (F.col("user_id") - 128).alias("offset_value"), "event_type", "value", F.col("value").alias("amount")
    )
    return suggest_storage(profile(rows)).select("name", "storage", "spark_type", "low_cardinality", "blank")
