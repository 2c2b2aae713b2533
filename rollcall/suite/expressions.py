"""Scalar expressions as they are written in query objects (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.expressions import cast_as, divide, first_present, is_false, is_true, xor
from rollcall.plans.query import run_query
from rollcall.suite import case, plain


def _select(t, table, key, *conditions, **exprs):
    columns = [key, *[{"eql": text, "name": name} for name, text in exprs.items()]]
    return plain(run_query({"table": table, "columns": columns, "conditions": [{"eql": c} for c in conditions]}, t.named(table)))


@case(
    "x1_arithmetic",
    """select o_orderkey, round((o_totalprice + o_custkey / 2) * 2 - 1, 4) as mixed,
       round(o_totalprice / nullif(o_custkey % 3, 0), 4) as ratio, o_totalprice / 1e-3 as scaled,
       o_totalprice / nullif(case when o_custkey % 2 = 0 then 0 else 4 end, 0) as cased,
       o_totalprice / +nullif(o_custkey % 5, 0) as plus, o_totalprice / -(nullif(o_custkey % 5, 0)) as minus,
       o_totalprice / (o_custkey + 1) / 2 * 3 as chained, o_custkey % 7 * 2 / 4 as noted from orders""",
)
def _(t):
    return _select(
        t, "orders", "o_orderkey",
        mixed="round((o_totalprice + o_custkey / 2) * 2 - 1, 4)",
        ratio="round(o_totalprice / mod(o_custkey, 3), 4)",
        scaled="o_totalprice / 1e-3",
        cased="o_totalprice / case when mod(o_custkey, 2) = 0 then 0 else 4 end",
        plus="o_totalprice / +mod(o_custkey, 5)",
        minus="o_totalprice / -(mod(o_custkey, 5))",
        chained="o_totalprice / (o_custkey + 1) / 2 * 3",
        noted="mod(o_custkey, 7) * 2 /* half of it: don't / touch */ / 4 -- quarter",
    )


@case(
    "x2_comparisons",
    """select l_orderkey, l_partkey, l_linenumber = 3 as eq, l_linenumber <> 3 as ne, l_linenumber != 4 as ne2, l_quantity < 10 as lt,
       l_quantity <= 10 as le, l_tax > 0.04 as gt, l_tax >= 0.04 as ge from lineitem""",
)
def _(t):
    columns = {
        "l_partkey": "l_partkey",
        "eq": "l_linenumber = 3",
        "ne": "l_linenumber <> 3",
        "ne2": "l_linenumber != 4",
        "lt": "l_quantity < 10",
        "le": "l_quantity <= 10",
        "gt": "l_tax > 0.04",
        "ge": "l_tax >= 0.04",
    }
    return _select(t, "lineitem", "l_orderkey", **columns)


@case(
    "x3_null_safe_equal",
    """select event_id, nullif(user_id, 5) is not distinct from nullif(event_id % 150, 7) as same from events""",
)
def _(t):
    return _select(t, "events", "event_id", same="nullif(user_id, 5) <=> nullif(mod(event_id, 150), 7)")


@case(
    "x4_and_or_not",
    """select event_id, (value > 50 and nullif(event_type, 'click') = 'view') as both_hold,
       (value > 50 or nullif(event_type, 'click') = 'view') as either_holds,
       not (nullif(event_type, 'click') = 'view') as negated, (value > 50 and not event_type = 'error') as kept from events""",
)
def _(t):
    return _select(
        t, "events", "event_id",
        both_hold="value > 50 && nullif(event_type, 'click') = 'view'",
        either_holds="value > 50 || nullif(event_type, 'click') = 'view'",
        negated="not (nullif(event_type, 'click') = 'view')",
        kept="value > 50 and !(event_type = 'error')",
    )


@case("x5_xor", """select event_id, (value > 50) <> (event_type = 'view') as one_of, (user_id > 70) <> (value > 20) as other,
       case when (value > 50) <> (value > 20) then 1 else 0 end::bigint as cased, (value > 50 and user_id > 70) <> (event_type = 'view') or user_id = 3 as mixed,
       coalesce((value > 50) <> (user_id between 10 and 20), false) as called from events""")
def _(t):
    found = _select(
        t, "events", "event_id",
        one_of="value > 50 xor event_type = 'view'",
        cased="case when value > 50 xor value > 20 then 1 else 0 end",
        mixed="value > 50 and user_id > 70 xor event_type = 'view' or user_id = 3",
        called="ifnull(xor(value > 50, user_id between 10 and 20), false)",
    )
    other = t.events.select("event_id", xor(F.col("user_id") > 70, F.col("value") > 20).alias("other"))
    return found.join(other, "event_id")


@case(
    "x6_between",
    """select p_partkey, p_size between 10 and 10 + 20 as inside, p_size not between 5 and 45 as outside from part""",
)
def _(t):
    return _select(t, "part", "p_partkey", inside="p_size between 10 and 10 + 20", outside="p_size not between 5 and 45")


@case(
    "x7_in",
    """select o_orderkey, o_orderstatus in ('F', 'P') as open, o_custkey not in (1, 2, 3) as others,
       o_custkey in (o_orderkey / 10, o_orderkey * 3, 899) as linked, o_orderstatus in ('O') as single from orders""",
)
def _(t):
    return _select(
        t, "orders", "o_orderkey",
        open="o_orderstatus in ('F', \"P\")",
        others="o_custkey not in (1, 2, 3)",
        linked="o_custkey in (o_orderkey / 10, o_orderkey * 3, 899)",
        single="o_orderstatus in ('O')",
    )


@case("x8_like", "select p_partkey, p_name like '%ring%' as ring, p_name not like 's%' as other, p_brand like 'Brand#_' as short from part")
def _(t):
    return _select(t, "part", "p_partkey", ring="p_name like '%ring%'", other='p_name not like "s%"', short="p_brand like 'Brand#_'")


@case(
    "x9_is_null",
    "select event_id, nullif(user_id, 8) is null as unknown, nullif(event_type, 'view') is not null as known from events",
)
def _(t):
    return _select(
        t, "events", "event_id", unknown="nullif(user_id, 8) is null", known="nullif(event_type, 'view') is not null"
    )


@case(
    "x10_is_true",
    """select event_id, (nullif(event_type, 'click') = 'view') is true as yes, (nullif(event_type, 'click') = 'view') is not true as not_yes,
       (nullif(event_type, 'click') = 'view') is false as no from events""",
)
def _(t):
    found = _select(
        t, "events", "event_id",
        yes="(nullif(event_type, 'click') = 'view') is true",
        not_yes="(nullif(event_type, 'click') = 'view') is not true",
    )
    test = F.nullif("event_type", F.lit("click")) == "view"
    return found.join(t.events.select("event_id", is_false(test).alias("no")), "event_id")


@case(
    "x11_case",
    """select l_orderkey, l_partkey, case when l_quantity > 30 then 'large' when l_quantity > 10 then 'medium' else 'small' end as size,
       case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' end as state from lineitem""",
)
def _(t):
    return _select(
        t, "lineitem", "l_orderkey",
        l_partkey="l_partkey",
        size="case when l_quantity > 30 then 'large' when l_quantity > 10 then \"medium\" else 'small' end",
        state="case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' end",
    )


@case("x12_if", "select event_id, case when value > 50 then 1 + 1 else user_id end::bigint as picked, case when event_type = 'view' then null else event_type end as other from events")
def _(t):
    return _select(t, "events", "event_id", picked="if(value > 50, 1 + 1, user_id)", other="if(event_type = 'view', null, event_type)")


@case(
    "x13_ifnull",
    """select event_id, coalesce(nullif(user_id, 8), nullif(event_id, 3), -1)::bigint as first_known, coalesce(nullif(event_type, 'view'), 'none') as kind from events""",
)
def _(t):
    return _select(
        t, "events", "event_id",
        first_known="ifnull(nullif(user_id, 8), nullif(event_id, 3), -1)",
        kind="ifnull(nullif(event_type, 'view'), 'none')",
    )


@case(
    "x14_casts",
    """select o_orderkey, cast(cast(o_orderdate as date) as varchar) as day, cast(o_custkey as varchar) as text,
       try_cast(split_part(o_orderpriority, '-', 1) as bigint) as lead, try_cast(o_orderpriority as bigint) as nothing,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as stamp, strftime(o_orderdate, '%H:%M:%S') as clock, try_cast(o_orderstatus as double) as number from orders""",
)
def _(t):
    found = _select(
        t, "orders", "o_orderkey",
        day="cast(o_orderdate as date)",
        text="cast(o_custkey as char)",
        lead="cast(substring_index(o_orderpriority, '-', 1) as signed)",
        nothing="cast(o_orderpriority as signed)",
        stamp="cast(cast(o_orderdate as char) as datetime)",
        clock="cast(o_orderdate as time)",
    )
    return found.join(t.orders.select("o_orderkey", cast_as("o_orderstatus", "double").alias("number")), "o_orderkey")


@case("x15_literals", "select n_nationkey::bigint as n_nationkey, 1.5::double as number, 'a && b' as text, 'say \"x\"' as quoted, cast(null as varchar) as nothing, true as yes, false as no from nation")
def _(t):
    return _select(
        t, "nation", "n_nationkey",
        number="cast(1.5 as double)", text='"a && b"', quoted="'say \"x\"'", nothing="cast(null as char)", yes="true", no="false",
    )


@case("x16_quoted_names", "select c_custkey, c_name as full_name, c_acctbal * 2 as doubled from customer")
def _(t):
    spec = {
        "table": "customer",
        "columns": ["c_custkey", {"eql": "[Full Name]", "name": "full_name"}, {"eql": "`customer`.`c_acctbal` * 2", "name": "doubled"}],
    }
    return run_query(spec, {"customer": t.customer.withColumnRenamed("c_name", "Full Name")})


@case(
    "x17_distinct_inside_aggregate",
    "select user_id, count(distinct event_type) as kinds, count(distinct cast(ts as date)) as days from events group by 1",
)
def _(t):
    spec = {
        "table": "events",
        "columns": ["user_id", {"eql": "count(distinct event_type)", "name": "kinds"}, {"eql": "count(distinct DAY(ts))", "name": "days"}],
        "groupBy": ["user_id"],
    }
    return run_query(spec, t.named("events"))


@case(
    "x18_pass_through",
    """select p_partkey, upper(p_name) as loud, length(p_name)::bigint as size, abs(p_size - 25)::bigint as off, round(sqrt(p_retailprice), 4) as root from part""",
)
def _(t):
    return _select(
        t, "part", "p_partkey", loud="upper(p_name)", size="length(p_name)", off="abs(p_size - 25)", root="round(sqrt(p_retailprice), 4)"
    )


@case(
    "x19_coalesce_nullif",
    """select event_id, coalesce(nullif(event_type, 'view'), nullif(event_type, 'click'), 'x') as kind, nullif(user_id, 8) as who,
       value / nullif(user_id, 0) as per_user, coalesce(nullif(user_id, 8), -1)::bigint as some_user, (value > 50) is true as high from events""",
)
def _(t):
    found = _select(
        t, "events", "event_id",
        kind="coalesce(nullif(event_type, 'view'), nullif(event_type, 'click'), 'x')",
        who="nullif(user_id, 8)",
    )
    other = t.events.select(
        "event_id",
        divide("value", "user_id").alias("per_user"),
        first_present(F.nullif("user_id", F.lit(8)), F.lit(-1)).cast("bigint").alias("some_user"),
        is_true(F.col("value") > 50).alias("high"),
    )
    return found.join(other, "event_id")
