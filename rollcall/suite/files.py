"""Sources and sinks (S): written to the shared folder, read back, and summed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators.timeline import append_email_domain
from rollcall.plans.query import read_query
from rollcall.session import scratch_path
from rollcall.sources import delimited, jsonlines, parquet, stored, tables as tb
from rollcall.suite import case, money, plain
from rollcall.suite.timelines import entries


@case(
    "s1_read_delimited",
    """select c_custkey::varchar as c_custkey, c_name || ', "' || c_mktsegment || '"' as label, nullif(case when c_acctbal < 0 then '' else c_mktsegment end, '') as segment,
       kind from customer cross join (values ('comma'), ('tab')) k(kind)""",
)
def _(t):
    rows = t.customer.select(
        "c_custkey",
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias(" label "),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
    )
    comma, tab = scratch_path(t.spark, "people"), scratch_path(t.spark, "people") + ".txt"
    # Files of one folder differ in the order of their columns, and some have no segment.
    csv = lambda part, columns: part.select(*columns).write.mode("append").option("header", True).option("escape", '"').option("compression", "gzip").csv(comma)
    third = F.col("c_custkey") % 3
    csv(rows.where((third == 0) | F.col("segment").isNotNull() & (third == 1)), ["c_custkey", " label ", "segment"])
    csv(rows.where(F.col("segment").isNull() & (third == 1)), ["c_custkey", " label "])
    csv(rows.where(third == 2), ["segment", "c_custkey", " label "])
    rows.write.option("header", True).option("escape", '"').option("sep", "\t").csv(tab)
    first = delimited.read_delimited(t.spark, comma).withColumn("kind", F.lit("comma"))
    return first.unionByName(delimited.read_delimited(t.spark, tab).withColumn("kind", F.lit("tab")))


@case(
    "s1_read_delimited_skip",
    """select s_suppkey::varchar as key, s_name as name from supplier""",
)
def _(t):
    # Files with a two-line preamble above the header; one file per nation.
    # Files of odd nations have the two columns the other way round.
    odd, key = F.col("s_nationkey") % 2 == 1, F.col("s_suppkey").cast("string")
    line = F.when(odd, F.concat_ws("|", "s_name", key, F.lit(""))).otherwise(F.concat_ws("|", key, "s_name", F.lit("")))
    lines = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit(3).alias("place"), line.alias("value"))
    heads = t.supplier.select("s_nationkey").distinct().select(
        F.col("s_nationkey").alias("nation"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(v).alias("value")) for i, v in enumerate(("exported by hand", ""))], F.struct(F.lit(2).alias("place"), F.when(odd, "name| key |").otherwise(" key |name|").alias("value")))).alias("h"),
    ).select("nation", "h.place", "h.value")
    path = scratch_path(t.spark, "preamble")
    ordered = lines.unionByName(heads).repartition("nation").sortWithinPartitions("nation", "place")
    ordered.select("nation", "value").write.partitionBy("nation").text(path)
    return delimited.read_delimited(t.spark, path, delimiter="|", skip=3)


@case(
    "s2_read_jsonl",
    """select event_id, event_type as kind, value, user_id % 2 = 0 as even from events""",
)
def _(t):
    line = F.concat(
        F.lit("{event_id: "), F.col("event_id").cast("string"), F.lit(", /* typed by hand */ 'kind': '"), "event_type",
        F.lit("', \"value\": "), F.col("value").cast("string"), F.lit(", even: "), (F.col("user_id") % 2 == 0).cast("string"), F.lit("}"),
    )
    path = scratch_path(t.spark, "json5")
    t.events.select(line.alias("value")).write.text(path)
    return jsonlines.read_jsonl(t.spark, path, "event_id bigint, kind string, value double, even boolean")


@case(
    "s3_read_jsonl_header",
    """select c_custkey::varchar as key, c_name as name, case when c_nationkey % 2 = 0 then c_mktsegment end as segment from customer""",
)
def _(t):
    # One file per nation, each with its own header line; odd nations lack a column.
    even = F.col("c_nationkey") % 2 == 0
    full = F.to_json(F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"))
    short = F.to_json(F.array("c_name", F.col("c_custkey").cast("string")))
    lines = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("place"), F.when(even, full).otherwise(short).alias("value"))
    header = F.when(even, F.lit('["key","name","segment"]')).otherwise(F.lit('["name","key"]'))
    heads = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit(0).alias("place"), header.alias("value")).distinct()
    path = scratch_path(t.spark, "headed")
    ordered = lines.unionByName(heads).repartition("nation").sortWithinPartitions("nation", "place")
    ordered.select("nation", "value").write.partitionBy("nation").text(path)
    return jsonlines.read_jsonl_header(t.spark, path).select("key", "name", "segment")


@case("s4_read_parquet", "select p_partkey as part_key, p_brand, p_name as full_part_name from part")
def _(t):
    path = scratch_path(t.spark, "named")
    t.part.select(F.col("p_partkey").alias("part_key"), "p_brand", "p_type", F.col("p_name").alias("Full Part Name")).write.parquet(path)
    return parquet.read_parquet(t.spark, path, ["part_key", "P_BRAND", "full_part_name"]).withColumnRenamed("P_BRAND", "p_brand")


@case("s5_read_query", "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1")
def _(t):
    t.customer.createOrReplaceTempView("people_of_record")
    t.nation.createOrReplaceTempView("nations_of_record")
    return read_query(
        t.spark,
        "select n_name, count(*) as customers from people_of_record join nations_of_record on c_nationkey = n_nationkey group by n_name",
    )


def input_uuid(key):
    return f"00000000-0000-4000-8000-{key:012d}"


def stored_inputs(t):
    """Customers of each region as a stored input: folders plugin / stored / input."""
    base = scratch_path(t.spark, "stored")
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    for key in range(5):
        plugin = input_uuid(900) if key < 2 else f"remote{key}"
        rows = people.where(F.col("n_regionkey") == key).select("c_custkey", "c_name", "c_acctbal")
        rows.write.parquet(f"{base}/{plugin}/stored/{input_uuid(key)}")
    return base


@case(
    "s6_scan_stored_inputs",
    """select '00000000-0000-4000-8000-00000000000' || n_regionkey as input_id,
       case when n_regionkey < 2 then '00000000-0000-4000-8000-000000000900' when n_regionkey = 4 then 'on-record' else 'plugin-' || n_regionkey end as plugin_id,
       count(*) as records from customer join nation on c_nationkey = n_nationkey group by 1, 2""",
)
def _(t):
    base = stored_inputs(t)
    key = F.col("r_regionkey")
    plugins = t.region.select(F.concat(F.lit("plugin-"), key).alias("id"), F.concat(F.lit("remote"), key).alias("remote_plugin_id"))
    inputs = t.region.where("r_regionkey = 4").select(
        F.concat(F.lit("00000000-0000-4000-8000-00000000000"), key).alias("id"), F.lit("on-record").alias("plugin_id")
    )
    files = t.spark.read.parquet(f"{base}/*/*/*")
    return stored.scan_stored_inputs(files, inputs, plugins).groupBy("input_id", "plugin_id").agg(F.count(F.lit(1)).alias("records"))


@case("s7_write_delimited", "select o_orderkey::varchar as o_orderkey, o_orderpriority, o_orderstatus from orders")
def _(t):
    path = scratch_path(t.spark, "orders")
    delimited.write_delimited(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), path, gzip=True)
    return delimited.read_delimited(t.spark, path)


@case(
    "s8_write_jsonl",
    "select count(*) as lines, count(*) filter (user_id = 8) as without_user from events",
)
def _(t):
    path = scratch_path(t.spark, "events")
    jsonlines.write_jsonl(t.events.select("event_id", F.nullif("user_id", F.lit(8)).alias("user_id"), "event_type"), path, gzip=True)
    lines = t.spark.read.text(path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("value").contains("user_id")).alias("without_user"))


def _file_rows(t):
    """Identified rows that still hold everything as the text they came in."""
    rows = entries(t).withColumn("email", F.concat(F.lit("u"), F.col("person_id").cast("string"), F.lit("@Mail.org")))
    return append_email_domain(rows).withColumn("value", F.col("value").cast("string")).withColumn("identifiers", F.array(F.lit("x")))


@case(
    "s9_write_identified",
    """select 'id,ts,entry_type_id,person_id,source_code_id,email_domain,props,value' as columns, 'double' as value_type, count(*) as records, count(*) as written,
       count(distinct user_id) as people, 'mail.org' as domain, cast(sum(cast(value as decimal(19,2))) as double) as total from events""",
)
def _(t):
    path = scratch_path(t.spark, "identified")
    done = parquet.write_identified(_file_rows(t).drop("email", "remote_entry_id").withColumn("email", F.lit("a@Mail.org")), path)
    rows = t.spark.read.parquet(path).drop("email")
    fixed, own = rows.columns[:6], sorted(rows.columns[6:])
    return rows.agg(
        F.lit(",".join(fixed + own)).alias("columns"),
        F.lit(rows.schema["value"].dataType.simpleString()).alias("value_type"),
        F.count(F.lit(1)).alias("records"),
        F.lit(done.records).cast("bigint").alias("written"),
        F.count_distinct("person_id").alias("people"),
        F.max("email_domain").alias("domain"),
        money("value").alias("total"),
    )


@case(
    "s10_write_identified_csv",
    """select 'id,ts,entry_type_id,person_id,source_code_id' as first_columns, false as has_identifiers, false as has_hash, count(*) as records, count(distinct user_id) as people from events""",
)
def _(t):
    path = scratch_path(t.spark, "identified")
    rows = _file_rows(t).withColumn("email_hash_v1", F.sha2("email", 256))
    parquet.write_identified_csv(rows, path, original=["ts", "email", "value"])
    back = delimited.read_delimited(t.spark, path)
    return back.agg(
        F.lit(",".join(back.columns[:5])).alias("first_columns"),
        F.lit("identifiers" in back.columns).alias("has_identifiers"),
        F.lit("email_hash_v1" in back.columns).alias("has_hash"),
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("person_id").alias("people"),
    )


def _new_table(t, label):
    """A catalog table name and a folder in the shared folder for its files."""
    path = scratch_path(t.spark, label)
    return "rollcall_" + path.rsplit("-", 1)[1], path


@case(
    "s11_create_and_load",
    """select 'bigint,date,double,string' as types, o_orderkey as order_key, strftime(o_orderdate, '%Y-%m-%d') as order_date, o_totalprice as order_total_, o_orderstatus as status from orders""",
)
def _(t):
    table, path = _new_table(t, "table")
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("Order Key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_totalprice").cast("string").alias("Order Total$"),
        F.col("o_orderstatus").alias("Status"),
        F.lit("x").alias("internal"),
    )
    twice = raw.unionByName(raw.where("`Status` = 'F'"))
    made = tb.create_and_load(twice, table, primary="order_key", ignore=["internal"], path=path)
    types = ",".join(f.dataType.simpleString() for f in made.schema.fields)
    return plain(made.withColumn("types", F.lit(types)))


@case(
    "s12_load_table",
    """select n_nationkey::bigint as n_nationkey, n_name, case when n_regionkey < 2 then n_regionkey end::bigint as n_regionkey from nation""",
)
def _(t):
    table, path = _new_table(t, "table")
    t.nation.where("n_regionkey < 2").write.option("path", path).saveAsTable(table)
    rest = t.nation.where("n_regionkey >= 2").select("n_name", "n_nationkey", F.lit("extra").alias("not_in_table"))
    return plain(tb.load_table(rest, table))


@case("s13_insert_from_query", "select c_custkey, c_name from customer where c_acctbal > 0 union all select s_suppkey, s_name from supplier")
def _(t):
    table, path = _new_table(t, "table")
    t.customer.where("c_acctbal > 0").select("c_custkey", "c_name").write.option("path", path).saveAsTable(table)
    t.supplier.createOrReplaceTempView("suppliers_to_insert")
    return tb.insert_from_query(t.spark, table, "select s_name as c_name, s_suppkey as c_custkey from suppliers_to_insert")


@case("s14_head_sample", "select least(3, count(*)) as head, least(10, count(*)) as sample from events")
def _(t):
    first, some = tb.head(t.events).select(F.lit("head").alias("k")), tb.sample(t.events).select(F.lit("sample").alias("k"))
    return first.unionByName(some).agg(F.count_if(F.col("k") == "head").alias("head"), F.count_if(F.col("k") == "sample").alias("sample"))


@case(
    "s15_sync_table",
    """select o_orderstatus, count(*) as orders, cast(sum(cast(o_totalprice as decimal(19,2))) as double) as total from orders
       where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01' group by 1""",
)
def _(t):
    path = scratch_path(t.spark, "synced")
    source = t.orders.withColumnRenamed("o_orderdate", "modified_at")
    # The second copy overlaps the first by a year.
    tb.sync_table(source, path, "1996-01-01", "1999-01-01")
    tb.sync_table(source, path, "1998-01-01", "2000-01-01")
    rows = tb.current(t.spark, path, ["o_orderkey"], ["modified_at"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("total"))


@case(
    "s15_sync_compacted",
    """select o_orderstatus, count(*) as orders, cast(sum(cast(case when o_orderdate < timestamp '1998-01-01' then o_totalprice else o_totalprice + 1 end as decimal(19,2))) as double) as total
       from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01' group by 1""",
)
def _(t):
    path = scratch_path(t.spark, "kept")
    source = t.orders.withColumnRenamed("o_orderdate", "modified_at")
    # What is copied again has changed; a last copy brings nothing new, and an older version of some rows.
    later = source.withColumn("o_totalprice", F.when(F.col("modified_at") >= "1998-01-01", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    stale = source.withColumns({"o_totalprice": F.lit(0.0), "modified_at": F.col("modified_at") - F.expr("interval 1 hour")})
    for rows, start, end in ((source, "1996-01-01", "1999-01-01"), (later, "1998-01-01", "2000-01-01"), (stale, "1997-01-01", "1998-01-01"), (later, "1998-01-01", "2000-01-01")):
        tb.sync_compacted(rows, path, ["o_orderkey"], ["modified_at"], start, end, buckets=8)
    rows = tb.current_compacted(t.spark, path, ["o_orderkey"], ["modified_at"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("total"))


@case(
    "s16_sync_tables",
    "select 'customer' as name, count(*) as records from customer union all select 'nation', count(*) from nation union all select 'supplier', count(*) from supplier",
)
def _(t):
    sources = t.named("customer", "nation", "supplier", "region", "part")
    sources["temp_customer"] = sources["customer"]
    copied = tb.sync_tables(sources, scratch_path(t.spark, "warehouse"), patterns=["^cust", "ION$", "supp", "customer"], exclude=["region"])
    out = None
    for name, frame in sorted(copied.items()):
        rows = frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("records"))
        out = rows if out is None else out.unionByName(rows)
    return out
