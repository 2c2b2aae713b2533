"""Enrichment, timeline and statistics (A, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import identity, timeline as tl
from rollcall.operators.merge import ensure_view
from rollcall.session import scratch_path
from rollcall.suite import case, money, plain

TYPES = {"click": 1, "signup": 2, "view": 3, "purchase": 4, "error": 5}
_TYPE_SQL = "case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 3 when 'purchase' then 4 else 5 end"


def coded_orders(t):
    """Orders with a source code typed in by hand: case and blanks vary, some are missing."""
    key = F.col("o_orderkey")
    code = (
        F.when(key % 10 == 0, "  ")
        .when(key % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority")))
        .otherwise(F.lower("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", "o_orderdate", code.alias("source_code"))


def known_codes(t):
    lead = F.substring("o_orderpriority", 1, 1).cast("bigint")
    return t.orders.where("o_orderpriority < '4'").select(lead.alias("source_code_id"), F.col("o_orderpriority").alias("source_code")).distinct()


_CODED = """with coded as (select o_orderkey, trim(case when o_orderkey % 10 = 0 then '  ' when o_orderkey % 2 = 0 then ' ' || upper(o_orderpriority) else lower(o_orderpriority) end) as source_code from orders),
    known as (select distinct lower(o_orderpriority) as k, cast(left(o_orderpriority, 1) as bigint) as id from orders where o_orderpriority < '4'),
    missing as (select lower(source_code) as k, arg_min(source_code, o_orderkey) as spelling from coded where source_code <> '' and lower(source_code) not in (select k from known) group by 1),
    added as (select k, spelling, row_number() over (order by md5(k), k) + (select max(id) from known) as id from missing),
    ids as (select k, id from known union all select k, id from added)"""


@case(
    "a1_append_dictionary_id",
    f"{_CODED} select o_orderkey, source_code, coalesce(ids.id, 0)::bigint as source_code_id from coded left join ids on ids.k = lower(source_code)",
)
def _(t):
    rows, _ = tl.append_dictionary_id(
        coded_orders(t), known_codes(t), "source_code", "source_code_id", "source_code_id", order=["o_orderkey"]
    )
    return rows.select("o_orderkey", "source_code", "source_code_id")


@case("a2_append_source_code_id", f"{_CODED} select id::bigint as source_code_id, spelling as source_code from added")
def _(t):
    return tl.append_source_code_id(coded_orders(t), known_codes(t), ["o_orderkey"])[1]


@case(
    "a3_append_input_id",
    """with named as (select event_id, coalesce(nullif(event_type, 'view'), 'default') as remote_input_id from events),
       known as (select 7::bigint as id, 'click' as k),
       added as (select k, row_number() over (order by md5(k), k) + (select max(n_nationkey) + 7 from nation) as id from (select distinct remote_input_id as k from named where remote_input_id <> 'click'))
       select event_id, remote_input_id, coalesce(known.id, added.id)::bigint as input_id from named left join known on known.k = remote_input_id left join added on added.k = remote_input_id""",
)
def _(t):
    # One input of this plugin and one of another plugin that has the same remote id.
    inputs = t.nation.where("n_nationkey = 0").select(
        F.lit(7).cast("bigint").alias("id"), F.lit("plugin-a").alias("plugin_id"), F.lit("Click").alias("remote_input_id")
    ).unionByName(
        t.nation.select(
            (F.col("n_nationkey") + 7).cast("bigint").alias("id"), F.lit("plugin-b").alias("plugin_id"), F.lit("signup").alias("remote_input_id")
        ).where("id > 7")
    )
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("remote_input_id"))
    found, _ = tl.append_input_id(rows, inputs, "plugin-a", "default")
    return found.select("event_id", "remote_input_id", "input_id")


@case(
    "a4_append_entry_type_id",
    f"select event_id, {_TYPE_SQL}::bigint as entry_type_id, (case when event_type = 'view' then 2 else {_TYPE_SQL} end)::bigint as with_default from events",
)
def _(t):
    rows = t.events.select("event_id", F.col("event_type").alias("entry_type"))
    found = tl.append_entry_type_id(rows, types=TYPES).select("event_id", "entry_type_id")
    gaps = rows.withColumn("entry_type", F.nullif("entry_type", F.lit("view")))
    other = tl.append_entry_type_id(gaps, "signup", TYPES).select("event_id", F.col("entry_type_id").alias("with_default"))
    return plain(found.join(other, "event_id"))


def _uuid_sql(source, kind, person, ts, remote):
    """The entry id layout: 48 bits of milliseconds, version 7, then digits of a SHA-1."""
    ms = f"(epoch_us({ts}) // 1000)"
    return f"""(select lpad(printf('%x', ms), 12, '0')[1:8] || '-' || lpad(printf('%x', ms), 12, '0')[9:12] || '-7' || h[1:3] || '-'
        || substr('89ab', ((strpos('0123456789abcdef', h[4]) - 1) % 4 + 1)::int, 1) || h[5:7] || '-' || h[8:19]
        from (select {ms} as ms, sha1(concat_ws('|', {source}, {kind}, {person}, {ms}::varchar, {remote})) as h))"""


@case("a5_append_entry_id", f"select event_id, {_uuid_sql(chr(39) + 'input-1' + chr(39), _TYPE_SQL, 'user_id', 'ts', 'event_id')} as id from events")
def _(t):
    rows = t.events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("entry_type"),
        F.col("user_id").alias("person_id"),
        F.col("event_id").alias("remote_transaction_id"),
    )
    typed = tl.append_entry_type_id(rows, types=TYPES)
    return tl.append_entry_id(typed, "input-1").select("event_id", "id")


@case("a6_append_email_domain", "select c_custkey, lower(c_mktsegment) || '.org' as email_domain from customer")
def _(t):
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".org")).alias("email"))
    return tl.append_email_domain(rows).select("c_custkey", "email_domain")


def activity(t):
    """Events as an activity file: who by remote id, e-mail and phone, what, when, from where.

    Two users share an e-mail; the second and third of ten share a phone, so that the first
    and the fourth are one person through them."""
    pair, ten = F.floor(F.col("user_id") / 2), F.floor(F.col("user_id") / 10)
    return t.events.select(
        F.col("event_id").alias("remote_entry_id"),
        "ts",
        F.when(F.col("event_type") == "purchase", "TRANSACTION").otherwise("FORM_SUBMIT").alias("entry_type"),
        F.col("user_id").alias("remote_person_id"),
        F.concat(F.lit("u"), pair.cast("string"), F.lit("@mail"), (pair % 60).cast("string"), F.lit(".org")).alias("email"),
        F.when((F.col("user_id") % 10).isin(1, 2), F.concat(F.lit("(555) "), F.lpad(ten.cast("string"), 7, "0"))).alias("phone"),
        F.col("event_type").alias("source_code"),
    )


_WHO = "case when user_id % 10 < 4 then user_id // 10 * 10 else user_id // 2 * 2 end"


@case(
    "a7_identify_input",
    f"""select event_id, case when event_type = 'purchase' then 10 else 20 end::bigint as entry_type_id, event_type as source_code,
       min(event_id) over (partition by {_WHO}) as root, 'mail' || (user_id // 2 % 60) || '.org' as email_domain, (select count(*) from events) as ids from events""",
)
def _(t):
    codes = t.spark.createDataFrame([], "source_code_id bigint, source_code string")
    rows, _, _ = tl.identify(
        activity(t), identity.empty_state(t.spark), codes, "shop", "input-1", row_id="remote_entry_id", order="remote_entry_id"
    )
    roots = rows.groupBy("person_id").agg(F.min(F.col("remote_entry_id").cast("bigint")).alias("root"))
    found = rows.join(roots, "person_id").select(
        F.col("remote_entry_id").cast("bigint").alias("event_id"), "entry_type_id", "source_code", "root", "email_domain"
    )
    return plain(found.withColumn("ids", rows.agg(F.count_distinct("id")).scalar()))


_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@case(
    "a8_identify_inputs",
    f"""select n_nationkey::varchar as id, strftime(least(timestamp '2024-01-02', min(ts)), {_STAMP}) as min_ts,
        strftime(greatest(timestamp '2024-01-20', max(ts)), {_STAMP}) as max_ts, count(event_id) as ids, count(distinct {_WHO}) as people
        from nation left join events on user_id % 20 = n_nationkey group by n_nationkey""",
)
def _(t):
    files = activity(t).withColumns({"input_id": (F.col("remote_person_id") % 20).cast("string"), "plugin_id": F.lit("shop")})
    codes = t.spark.createDataFrame([], "source_code_id bigint, source_code string")
    inputs = t.nation.select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.lit("2024-01-02").cast("timestamp").alias("min_ts"),
        F.lit("2024-01-20").cast("timestamp").alias("max_ts"),
    )
    rows, _, _, bounds = tl.identify_inputs(
        files, identity.empty_state(t.spark), codes, inputs, row_id="remote_entry_id", order="remote_entry_id"
    )
    found = rows.groupBy(F.col("input_id").alias("id")).agg(
        F.count_distinct("id").alias("ids"), F.count_distinct("person_id").alias("people")
    )
    whole = bounds.join(found, "id", "left")
    return plain(whole.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ids", "people")}))


def entries(t):
    """Events as identified timeline entries."""
    typed = tl.append_entry_type_id(
        t.events.select(
            "ts",
            F.col("event_type").alias("entry_type"),
            F.col("user_id").alias("person_id"),
            F.col("event_id").alias("remote_entry_id"),
            (F.col("event_id") % 50).alias("source_code_id"),
            "value",
            "props",
        ),
        types=TYPES,
    )
    return tl.append_entry_id(typed, "input-1")


@case(
    "l1_load_timeline",
    """select entry_type_id, count(*) as records, sum(source_code_id)::bigint as codes, count(distinct person_id) as people, count(*) as in_input from
       (select """ + _TYPE_SQL + """::bigint as entry_type_id, event_id % 50 as source_code_id, user_id as person_id from events) group by 1""",
)
def _(t):
    rows = entries(t)
    path = scratch_path(t.spark, "timeline")
    # The timeline already holds the purchases, with a source code that is out of date.
    stored = rows.where("entry_type_id = 4").withColumn("source_code_id", F.lit(0).cast("bigint"))
    # A file has an earlier version of every entry above its last one.
    earlier = rows.withColumn("source_code_id", F.lit(-1).cast("bigint")).withColumn("line", F.lit(1))
    file = earlier.unionByName(rows.withColumn("line", F.lit(2)))
    tl.load_timeline_files(stored.withColumn("line", F.lit(1)), path, ["line"], "old")
    tl.load_timeline_files(file, path, ["line"], "input-1")
    tl.load_timeline_files(file, path, ["line"], "input-1")
    return plain(
        t.spark.read.parquet(path).groupBy("entry_type_id").agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("source_code_id").alias("codes"),
            F.count_distinct("person_id").alias("people"),
            F.count_if(F.col("input_id") == "input-1").alias("in_input"),
        )
    )


@case(
    "l2_load_details",
    """select event_type as entry_type, count(*) as records, cast(sum(cast(value as decimal(19,2))) as double) as total, count(distinct props) as props from events group by 1""",
)
def _(t):
    rows = entries(t)
    # The first file knows no props: the column comes with the second one.
    made = tl.load_details(rows.where("value > 50").drop("props"))
    full = tl.load_details(rows, made)
    return full.groupBy("entry_type").agg(
        F.count(F.lit(1)).alias("records"), money("value").alias("total"), F.count_distinct("props").alias("props")
    )


@case(
    "l3_detail_schema",
    """select * from (values ('id', 'uuid'), ('entry_type', 'string'), ('remote_entry_id', 'int'), ('value', 'double'), ('props', 'string')) v(name, type)
       where (select count(*) from events) > 0""",
)
def _(t):
    return tl.detail_schema(entries(t)).select("name", "type")


@case(
    "l4_load_timeline_tables",
    """select user_id % 3 as file, count(*) as entries, count(*) as details from events group by 1""",
)
def _(t):
    rows = entries(t).withColumn("input_id", (F.col("person_id") % 3).cast("string"))
    # Three identified files; the second is delivered twice.
    files = rows.unionByName(rows.where("input_id = '1'"))
    columns = ["id", "ts", "person_id", "entry_type_id", "source_code_id", "input_id"]
    timeline = tl.load_timeline(files, rows.select(*columns).limit(0), ["value"])
    details = tl.load_details(files).withColumnRenamed("id", "detail_id")
    both = timeline.join(details, F.col("id") == F.col("detail_id"), "left")
    return both.groupBy(F.col("input_id").cast("bigint").alias("file")).agg(
        F.count(F.lit(1)).alias("entries"), F.count("detail_id").alias("details")
    )


@case(
    "l5_timeline_detail_summary",
    """select case event_type when 'error' then 'N/A' else event_type end as entry_type, r_name as plugin_name, count(*) as records,
       count(s.source_code_id) as coded, cast(sum(cast(value as decimal(19,2))) as double) as total
       from events join nation on n_nationkey = user_id % 20 join region on n_regionkey = r_regionkey
       left join (select distinct p_size as source_code_id from part) s on s.source_code_id = event_id % 50 group by 1, 2""",
)
def _(t):
    rows = entries(t).withColumn("input_id", F.col("person_id") % 20)
    timeline = rows.select("id", "ts", "person_id", "entry_type_id", "source_code_id", "input_id")
    details = rows.select("id", "value", "props")
    inputs = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("plugin_id"))
    plugins = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    codes = t.part.select(F.col("p_size").alias("source_code_id"), F.col("p_size").cast("string").alias("source_code")).distinct()
    known = {name: code for name, code in TYPES.items() if name != "error"}
    summary = tl.timeline_detail_summary(details, timeline, inputs, plugins, codes, known)
    view = ensure_view("event_detail_summary", summary, replace=True)
    return view.groupBy("entry_type", "plugin_name").agg(
        F.count(F.lit(1)).alias("records"), F.count("source_code_id").alias("coded"), money("value").alias("total")
    )


@case("l6_timeline_range", "select event_id, user_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12 06:00:00'")
def _(t):
    return tl.timeline_range(t.events, "2024-01-05", "2024-01-12 06:00:00").select("event_id", "user_id")


@case(
    "l6_stored_range",
    f"""select event_id, {_TYPE_SQL}::bigint as entry_type_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12 06:00:00'""",
)
def _(t):
    path = scratch_path(t.spark, "timeline")
    rows = entries(t).withColumn("source_code_id", F.col("remote_entry_id").cast("bigint"))
    # Every fortieth entry came with an id of its own, which tells no day or a wrong one.
    own = F.when(F.col("remote_entry_id") % 80 == 0, F.concat(F.lit("7b1c2d3e-0000-4000-8000-"), F.lpad("remote_entry_id", 12, "0")))
    wrong = F.when(F.col("remote_entry_id") % 80 == 40, F.concat(F.lit("018d0000-0000-7000-8000-"), F.lpad("remote_entry_id", 12, "0")))
    tl.load_timeline_files(rows.withColumn("id", F.coalesce(own, wrong, "id")), path, ["value"], "input-1")
    found = tl.stored_range(t.spark, path, "2024-01-05", "2024-01-12 06:00:00")
    return found.select(F.col("source_code_id").alias("event_id"), F.col("entry_type_id").cast("bigint").alias("entry_type_id"))


def delivered_twice(t):
    """Entries as files hold them after a second delivery: some ids occur twice, with another
    type and person in the first one."""
    rows = t.events.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("person_id"), F.col("event_type").alias("entry_type"),
        F.concat(F.lit("mail"), (F.col("user_id") % 60).cast("string"), F.lit(".org")).alias("email_domain"),
        (F.col("event_id") % 3).alias("source"),
    )
    first = rows.where("entry_type = 'view'").withColumn("entry_type", F.lit("draft"))
    first = first.withColumn("person_id", F.lit(-1).cast("bigint")).withColumn("delivery", F.lit(1))
    return rows.withColumn("delivery", F.lit(2)).unionByName(first)


@case(
    "l7_stats_total",
    f"select count(*) as records, count(distinct user_id) as distinct_people, strftime(min(ts), {_STAMP}) as min_ts, strftime(max(ts), {_STAMP}) as max_ts from events",
)
def _(t):
    return plain(tl.stats_total(tl.once(delivered_twice(t), ["delivery"])))


@case("l8_stats_by_type", "select event_type as entry_type, count(*) as records, count(distinct user_id) as distinct_people from events group by 1")
def _(t):
    return tl.stats_by_type(tl.once(delivered_twice(t), ["delivery"]), "entry_type")


_BY_DATE = "select strftime(ts, '%Y-%m-%d') as date, event_type as entry_type, count(*) as records, count(distinct user_id) as distinct_people from events group by 1, 2"


@case("l9_stats_by_type_by_date", _BY_DATE)
def _(t):
    rows = t.events.select("ts", F.col("user_id").alias("person_id"), F.col("event_type").alias("entry_type"))
    return tl.stats_by_type_by_date(rows, "entry_type")


_DOMAIN = "'mail' || (user_id % 60) || '.org'"


@case(
    "l10_stats_by_email_domain",
    f"""with big as (select {_DOMAIN} as d from events group by 1 order by count(*) desc, d limit 50)
        select {_DOMAIN} as email_domain, event_type as entry_type, count(*) as records, count(distinct user_id) as distinct_people
        from events where {_DOMAIN} in (select d from big) group by 1, 2""",
)
def _(t):
    return tl.stats_by_email_domain(tl.once(delivered_twice(t), ["delivery"]), "entry_type")


@case(
    "l11_input_statistics",
    f"""with sizes as (select event_id % 3 as source, {_DOMAIN} as d, row_number() over (partition by event_id % 3 order by count(*) desc, {_DOMAIN}) as place from events group by 1, 2)
        select 'total' as part, event_id % 3 as source, null as date, null as entry_type, null as email_domain, count(*) as records, count(distinct user_id) as distinct_people from events group by 2
        union all select 'by_type', event_id % 3, null, event_type, null, count(*), count(distinct user_id) from events group by 2, 4
        union all select 'by_type_by_date', event_id % 3, strftime(ts, '%Y-%m-%d'), event_type, null, count(*), count(distinct user_id) from events group by 2, 3, 4
        union all select 'by_email_domain', event_id % 3, null, event_type, {_DOMAIN}, count(*), count(distinct user_id) from events
        join sizes on sizes.source = event_id % 3 and sizes.d = {_DOMAIN} and sizes.place <= 50 group by 2, 4, 5""",
)
def _(t):
    stats = tl.input_statistics(delivered_twice(t), ["delivery"], "source", "entry_type")

    def lined_up(name):
        rows = stats[name]
        columns = ["source", "date", "entry_type", "email_domain", "records", "distinct_people"]
        return rows.select(
            F.lit(name).alias("part"),
            *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns],
        )

    out = lined_up("total")
    for name in ("by_type", "by_type_by_date", "by_email_domain"):
        out = out.unionByName(lined_up(name))
    return out
