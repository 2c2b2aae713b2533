"""Date functions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import dates as d
from rollcall.plans.query import run_query
from rollcall.suite import case, plain


@case("d1_now", "select event_type, count(*) as records from events where ts < current_timestamp::timestamp group by 1")
def _(t):
    spec = {
        "table": "events",
        "columns": ["event_type", {"eql": "count(*)", "name": "records"}],
        "conditions": [{"eql": "ts < now() and ts < getdate()"}],
        "groupBy": ["event_type"],
    }
    return run_query(spec, t.named("events"))


_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@case(
    "d2_intervals",
    f"""select event_id, strftime(ts + interval 3 day, {_STAMP}) as later, strftime(ts - interval 90 second, {_STAMP}) as earlier,
        strftime(ts + interval 6 month, {_STAMP}) as two_quarters, strftime(ts - to_months(cast(user_id as int)), {_STAMP}) as months_back,
        strftime(ts + interval 2 week, {_STAMP}) as weeks, strftime(ts + interval 1 year, {_STAMP}) as year from events""",
)
def _(t):
    columns = {
        "later": "date_add(ts, interval 3 day)",
        "earlier": "date_sub(ts, interval 90 second)",
        "two_quarters": "ts + interval 2 quarter",
        "months_back": "date_sub(ts, interval user_id month)",
        "weeks": "ts + interval 2 week",
        "year": "date_add(ts, interval (2 - 1) year)",
    }
    spec = {"table": "events", "columns": ["event_id", *[{"eql": e, "name": n} for n, e in columns.items()]]}
    return plain(run_query(spec, t.named("events")))


def _one(t, table, key, ts, **columns):
    return plain(t[table].select(key, *[c.alias(n) for n, c in columns.items()]))


@case("d3_day", "select event_id, cast(cast(ts as date) as varchar) as day, cast(cast(ts as date) as varchar) as again from events")
def _(t):
    found = _one(t, "events", "event_id", "ts", day=d.day("ts"))
    spec = {"table": "events", "columns": ["event_id", {"eql": "DATE(ts)", "name": "again"}]}
    return found.join(plain(run_query(spec, t.named("events"))), "event_id")


@case("d4_week", "select o_orderkey, cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as int) as varchar) as week from orders")
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", week=d.week("o_orderdate"))


@case("d5_month", "select o_orderkey, cast(date_trunc('month', o_orderdate)::date as varchar) as month from orders")
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", month=d.month("o_orderdate"))


@case("d6_year", "select o_orderkey, year(o_orderdate)::bigint as year from orders")
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", year=d.year("o_orderdate"))


@case(
    "d7_quarter",
    "select o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) as label, cast(date_trunc('quarter', o_orderdate)::date as varchar) as start from orders",
)
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", label=d.quarter_label("o_orderdate"), start=d.quarter_start("o_orderdate"))


@case("d8_year_start", "select o_orderkey, year(o_orderdate) || '-01-01' as start from orders")
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", start=d.year_start("o_orderdate"))


@case("d9_names", "select o_orderkey, monthname(o_orderdate) as month, strftime(o_orderdate, '%Y%m%d') as short from orders")
def _(t):
    return _one(t, "orders", "o_orderkey", "o_orderdate", month=d.month_name("o_orderdate"), short=d.short_date("o_orderdate"))


@case(
    "d10_fiscal_year",
    """select o_orderkey, year(o_orderdate + interval 6 month)::bigint as july, year(o_orderdate + interval 3 month - interval 14 day)::bigint as october,
       year(o_orderdate)::bigint as january from orders""",
)
def _(t):
    return _one(
        t, "orders", "o_orderkey", "o_orderdate",
        july=d.fiscal_year("o_orderdate", "07-01"),
        october=d.fiscal_year("o_orderdate", "10-15"),
        january=d.fiscal_year("o_orderdate"),
    )


@case(
    "d11_day_of_year",
    """select o_orderkey, dayofyear(o_orderdate)::bigint as day,
       date_diff('day', make_date(year(o_orderdate + interval 6 month) - 1, 7, 1), cast(o_orderdate as date))::bigint as fiscal_day from orders""",
)
def _(t):
    return _one(
        t, "orders", "o_orderkey", "o_orderdate",
        day=d.day_of_year("o_orderdate"), fiscal_day=d.day_of_fiscal_year("o_orderdate", "07-01"),
    )


@case(
    "d12_day_difference",
    "select l_orderkey, l_partkey, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))::bigint as days from lineitem join orders on l_orderkey = o_orderkey",
)
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(joined.select("l_orderkey", "l_partkey", d.day_diff("l_shipdate", "o_orderdate").alias("days")))


# The events all fall in January, when New York is five hours behind UTC and Berlin one ahead.
@case(
    "d13_time_zone",
    f"select event_id, strftime(ts - interval 5 hour, {_STAMP}) as new_york, strftime(ts + interval 1 hour, {_STAMP}) as berlin from events",
)
def _(t):
    return _one(t, "events", "event_id", "ts", new_york=d.in_zone("ts"), berlin=d.in_zone("ts", "Europe/Berlin"))


@case(
    "d14_shift",
    f"select event_id, strftime(ts + interval 10 day, {_STAMP}) as days, strftime(ts - interval 36 hour, {_STAMP}) as hours from events",
)
def _(t):
    return _one(t, "events", "event_id", "ts", days=d.shift("ts", 10, "day"), hours=d.shift("ts", -36, "hour"))


@case(
    "d15_date_window",
    """select 'relative' as bounds, count(*) as records, min(event_id) as first_id, max(event_id) as last_id from events
         where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20 12:00:00'
       union all select 'millis', count(*), min(event_id), max(event_id) from events where ts >= to_timestamp(1704844800)::timestamp
       union all select 'week', count(*), min(event_id), max(event_id) from events where ts >= timestamp '2024-01-07' and ts < timestamp '2024-01-31 23:59:59.999'""",
)
def _(t):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")

    def counted(name, start, end):
        rows = d.date_window(t.events, "ts", start, end, at)
        return rows.agg(
            F.lit(name).alias("bounds"),
            F.count(F.lit(1)).alias("records"),
            F.min("event_id").alias("first_id"),
            F.max("event_id").alias("last_id"),
        )

    found = counted("relative", "-10d.start.day", "now").unionByName(counted("millis", "1704844800000", None))
    return found.unionByName(counted("week", "-1w.start.week", "+0M.end.month"))


@case(
    "d16_clean_date",
    """select o_orderkey, case o_orderkey % 7
         when 0 then strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') when 1 then strftime(o_orderdate, '%Y-%m-01T00:00:00.000Z')
         when 2 then strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') when 3 then strftime(o_orderdate, '%Y-%m-01T00:00:00.000Z')
         when 4 then strftime(o_orderdate, '%Y-01-01T00:00:00.000Z') when 5 then null
         else strftime(o_orderdate, '%Y-%m-01T00:00:00.000Z') end as cleaned from orders""",
)
def _(t):
    def as_text(fmt):
        return F.date_format("o_orderdate", fmt)

    pick = F.col("o_orderkey") % 7
    typed_in = (
        F.when(pick == 0, as_text("M/d/yyyy"))
        .when(pick == 1, as_text("MM/yyyy"))
        .when(pick == 2, as_text("MM/dd/yy"))
        .when(pick == 3, as_text("yyyy-MM"))
        .when(pick == 4, as_text("yyyy"))
        .when(pick == 5, F.concat(F.lit("not a date "), as_text("yyyy")))
        .otherwise(as_text("M/yy"))
    )
    return d.clean_date(t.orders.select("o_orderkey", typed_in.alias("raw")), "raw", "cleaned").select("o_orderkey", "cleaned")
