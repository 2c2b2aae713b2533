"""Reports (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.plans.reports import run_report
from rollcall.suite import case, plain

SOURCES = {
    "default": {"table": "orders", "date_column": "o_orderdate"},
    "filtered": {
        "table": "orders",
        "conditions": ["o_orderstatus <> 'P'"],
        "queryStringConditions": [{"type": "GREATER_THAN", "values": [{"ref": {"column": "o_totalprice"}}, {"value": {"value": 50000}}]}],
    },
    "per_customer": {
        "table": "spent",
        "subquery": {
            "table": "orders",
            "date_column": "o_orderdate",
            "columns": [
                {"eql": "o_custkey", "name": "person_id"},
                {"eql": "count(*)", "name": "orders"},
                {"eql": "sum(cast(o_totalprice as decimal(19,2)))", "name": "amount"},
            ],
            "groupBy": [{"eql": "o_custkey"}],
        },
    },
}
AMOUNT = {"eql": "cast(sum(cast(o_totalprice as decimal(19,2))) as double)", "name": "amount"}
COUNT = {"eql": "count(*)", "name": "orders"}
_SUM = "cast(sum(cast(o_totalprice as decimal(19,2))) as double)"


def component(t, overrides=None, **spec):
    report = {"data_sources": SOURCES, "components": {"title": "Orders", "chart": spec}}
    return plain(run_report(report, t.named("orders"), overrides)["chart"])


@case(
    "r1_run_report",
    f"""select 'total' as part, null as label, count(*) as orders, {_SUM} as amount from orders
        union all select 'by_status', o_orderstatus, count(*), {_SUM} from orders group by 2
        union all select 'by_priority', o_orderpriority, count(*), {_SUM} from orders where o_orderstatus <> 'P' and o_totalprice > 50000 group by 2""",
)
def _(t):
    report = {
        "data_sources": SOURCES,
        "components": {
            "title": "Orders at a glance",
            "total": {"metrics": [COUNT, AMOUNT]},
            "by_status": {"dimension": {"eql": "o_orderstatus", "name": "label"}, "metrics": [COUNT, AMOUNT]},
            "by_priority": {"data_source": "filtered", "dimension": {"eql": "o_orderpriority", "name": "label"}, "metrics": [COUNT, AMOUNT]},
        },
    }
    parts = run_report(report, t.named("orders"))
    frames = [
        frame.select(F.lit(name).alias("part"), (F.col("label") if "label" in frame.columns else F.lit(None).cast("string")).alias("label"), "orders", "amount")
        for name, frame in parts.items()
        if name != "title"
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@case(
    "r2_dimensions_breakdown_metrics",
    f"""select o_orderpriority as priority, year(o_orderdate)::bigint as col1, o_orderstatus as status, count(*) as orders, {_SUM} as amount,
        max(o_totalprice) as col5 from orders group by 1, 2, 3""",
)
def _(t):
    return component(
        t,
        dimensions=[{"eql": "o_orderpriority", "name": "priority"}, {"eql": "YEAR(o_orderdate)"}],
        breakdown={"eql": "o_orderstatus", "name": "status"},
        metric=COUNT,
        metrics=[AMOUNT, {"eql": "max(o_totalprice)"}],
    )


def _bucketed(t, days):
    return component(
        t, {"days": days}, isDate=True, dimension={"eql": "o_orderdate"}, breakdown={"eql": "o_orderstatus", "name": "status"},
        metrics=[COUNT], orderBy=[{"eql": "dimension_name"}, {"eql": "status"}],
    ).withColumn("dimension_name", F.col("dimension_name").cast("string"))


@case(
    "r3_adaptive_date_bucket",
    """select 'year' as bucket, year(o_orderdate)::varchar as dimension_name, o_orderstatus as status, count(*) as orders from orders group by 2, 3
       union all select 'month', cast(date_trunc('month', o_orderdate)::date as varchar), o_orderstatus, count(*) from orders group by 2, 3
       union all select 'week', cast(cast(o_orderdate as date) - cast(dayofweek(o_orderdate) as int) as varchar), o_orderstatus, count(*) from orders group by 2, 3
       union all select 'day', cast(cast(o_orderdate as date) as varchar), o_orderstatus, count(*) from orders group by 2, 3""",
)
def _(t):
    out = None
    for name, days in (("year", 2000), ("month", 400), ("week", 200), ("day", 30)):
        rows = _bucketed(t, days).withColumn("bucket", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@case(
    "r4_date_window",
    f"""select o_orderstatus as status, count(*) as orders, {_SUM} as amount from orders
        where o_orderdate >= timestamp '1997-02-01' and o_orderdate < timestamp '1998-05-15' group by 1""",
)
def _(t):
    # Counted back from a fixed day: three months and a bit over a year before it.
    report = {"data_sources": SOURCES, "components": {"chart": {"dimension": {"eql": "o_orderstatus", "name": "status"}, "metrics": [COUNT, AMOUNT]}}}
    at = F.lit("1998-05-15").cast("timestamp")
    return plain(run_report(report, t.named("orders"), {"start": "-15M.start.month", "end": "now"}, at)["chart"])


@case(
    "r5_derived_table",
    """select case when orders > 4 then 'many' when orders > 2 then 'some' else 'few' end as level, count(*) as people, cast(sum(amount) as double) as amount
       from (select o_custkey, count(*) as orders, sum(cast(o_totalprice as decimal(19,2))) as amount from orders
             where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by 1) group by 1""",
)
def _(t):
    return component(
        t,
        {"start": "1996-01-01", "end": "1998-01-01"},
        data_source="per_customer",
        dimension={"eql": "case when spent.orders > 4 then 'many' when spent.orders > 2 then 'some' else 'few' end", "name": "level"},
        metrics=[{"eql": "count(person_id)", "name": "people"}, {"eql": "cast(sum(amount) as double)", "name": "amount"}],
    )


@case(
    "r6_scorecard",
    f"select count(*) as orders, {_SUM} as amount, count(distinct o_custkey) as people, round({_SUM} / count(*), 2) as average from orders",
)
def _(t):
    return component(
        t,
        metrics=[
            COUNT,
            AMOUNT,
            {"eql": "count(distinct o_custkey)", "name": "people"},
            {"eql": "round(cast(sum(cast(o_totalprice as decimal(19,2))) as double) / count(*), 2)", "name": "average"},
        ],
    )


@case(
    "r7_source_filters",
    """select o_orderpriority as priority, o_orderstatus as status, count(*) as orders from orders
       where o_orderstatus <> 'P' and o_totalprice > 50000 and o_custkey > 100 group by 1, 2""",
)
def _(t):
    return component(
        t,
        data_source="filtered",
        dimension={"eql": "o_orderpriority", "name": "priority"},
        breakdown={"eql": "o_orderstatus", "name": "status"},
        metric=COUNT,
        conditions=["o_custkey > 100"],
    )
