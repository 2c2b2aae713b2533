"""Streaming (W): driven to the end of the data with availableNow, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators.timeline import entry_day
from rollcall.session import scratch_path
from rollcall.streaming import timeline as st
from rollcall.suite import case, money
from rollcall.suite.files import stored_inputs
from rollcall.suite.timelines import entries


@case(
    "w1_stream_inputs",
    """select '00000000-0000-4000-8000-00000000000' || n_regionkey as input_id, count(*) as records, cast(sum(cast(c_acctbal as decimal(19,2))) as double) as balance
       from customer join nation on c_nationkey = n_nationkey group by 1""",
)
def _(t):
    base = stored_inputs(t)
    out, marks = scratch_path(t.spark, "picked-up"), scratch_path(t.spark, "marks")
    schema = "c_custkey bigint, c_name string, c_acctbal double"

    def pick_up():
        rows = st.stream_inputs(t.spark, f"{base}/*/*/*", schema, files_per_batch=3).drop("_file")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
        query.trigger(availableNow=True).start().awaitTermination()

    pick_up()
    pick_up()  # Nothing new has arrived: nothing may be read twice.
    return t.spark.read.parquet(out).groupBy("input_id").agg(F.count(F.lit(1)).alias("records"), money("c_acctbal").alias("balance"))


def _deliver(t, pick_up):
    """Timeline entries as files, the newest days delivered first and some entries twice; each
    delivery is a folder of its own and picked up when it is complete."""
    path = scratch_path(t.spark, "arrivals")
    rows = entries(t).select("id", "ts", "person_id", "entry_type_id", "source_code_id", "value")
    rows = rows.unionByName(rows.where("entry_type_id = 3"))
    day = F.dayofmonth("ts")
    for low, high in ((21, 31), (11, 20), (1, 10)):
        rows.where(day.between(low, high)).write.parquet(f"{path}/from-{low:02d}")
        pick_up(st.stream_inputs(t.spark, f"{path}/*", rows.schema, from_path=False, file_time="file_time")).awaitTermination()


@case("w2_stream_timeline_dedupe", "select event_type as kind, count(*) as records, count(distinct user_id) as people from events group by 1")
def _(t):
    out, marks = scratch_path(t.spark, "deduped"), scratch_path(t.spark, "marks")

    def pick_up(rows):
        query = st.stream_timeline_dedupe(rows).writeStream.format("parquet").option("path", out)
        return query.option("checkpointLocation", marks).trigger(availableNow=True).start()

    _deliver(t, pick_up)
    names = F.element_at(F.array(*[F.lit(n) for n in ("click", "signup", "view", "purchase", "error")]), F.col("entry_type_id"))
    found = t.spark.read.parquet(out).groupBy(names.alias("kind"))
    return found.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("person_id").alias("people"))


@case(
    "w3_stream_upsert",
    """select strftime(ts, '%Y-%m-%d') as day, count(*) as records, cast(sum(cast(value as decimal(19,2))) as double) as total from events group by 1""",
)
def _(t):
    out, marks = scratch_path(t.spark, "timeline"), scratch_path(t.spark, "marks")
    _deliver(t, lambda rows: st.stream_upsert(rows, out, marks, ["file_time"]))
    stored = t.spark.read.parquet(out)
    return stored.groupBy(entry_day("id").alias("day")).agg(F.count(F.lit(1)).alias("records"), money("value").alias("total"))


@case(
    "w4_stream_statistics",
    """select strftime(ts, '%Y-%m-%d') as date, case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 3 when 'purchase' then 4 else 5 end::bigint as entry_type_id,
       count(*) as records, count(distinct user_id) as distinct_people from events group by 1, 2""",
)
def _(t):
    timeline, out, marks = (scratch_path(t.spark, name) for name in ("timeline", "statistics", "marks"))
    _deliver(t, lambda rows: st.stream_statistics(rows, timeline, out, marks, ["file_time"]))
    counted = st.read_statistics(t.spark, out, ["date", "entry_type_id"])
    return counted.withColumn("entry_type_id", F.col("entry_type_id").cast("bigint"))


@case(
    "w4_statistics_totals",
    """select case event_type when 'click' then 1 when 'signup' then 2 when 'view' then 3 when 'purchase' then 4 else 5 end::bigint as entry_type_id,
       count(*) as records, count(distinct user_id) as distinct_people from events group by 1
       union all select null, count(*), count(distinct user_id) from events""",
)
def _(t):
    # Totals over all days come from the bitmaps of the days alone.
    timeline, out, marks = (scratch_path(t.spark, name) for name in ("timeline", "statistics", "marks"))
    _deliver(t, lambda rows: st.stream_statistics(rows, timeline, out, marks, ["file_time"]))
    by_type = st.read_statistics(t.spark, out, ["entry_type_id"]).withColumn("entry_type_id", F.col("entry_type_id").cast("bigint"))
    whole = st.read_statistics(t.spark, out, []).withColumn("entry_type_id", F.lit(None).cast("bigint"))
    return by_type.unionByName(whole)
