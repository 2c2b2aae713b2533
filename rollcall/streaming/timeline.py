"""The timeline kept current from a drop zone: pick up, de-duplicate, upsert, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.merge import folder_bounds, read_files, upsert_files
from rollcall.operators.timeline import entry_day, people_bitmaps, roll_up
from rollcall.session import materialize
from rollcall.sources.stored import input_from_path, with_path


def stream_inputs(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    files_per_batch: int = 1000,
    from_path: bool = True,
    options: dict[str, str] | None = None,
    file_time: str | None = None,
) -> DataFrame:
    """Rows of new files below ``path`` as they appear, with input and plugin ids
    from the path.  ``files_per_batch`` bounds the work of one micro-batch.  ``file_time``
    names a column for the time each row's file was written: an order for upserts."""
    rows = (
        spark.readStream.format(format)
        .schema(schema)
        .options(**(options or {}))
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    if file_time:
        rows = rows.withColumn(file_time, F.col("_metadata.file_modification_time"))
    return input_from_path(with_path(rows)) if from_path else rows


def stream_timeline_dedupe(rows: DataFrame, key: str = "id", delay: str = "1 day") -> DataFrame:
    """Each entry id once among the rows that arrive within ``delay`` of each other; the
    state kept is bounded by it.

    The watermark is on the time of arrival, never on an entry's own time, so a backfill
    of old entries loses none.  A copy that arrives later than ``delay`` comes through and is
    absorbed by the upsert downstream.
    """
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def stream_upsert(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    order: list[str],
    keys: list[str] = ("id",),
    partition: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Every micro-batch written over the table at ``path``.  ``order`` decides between rows
    of one key in a batch (see ``file_time`` of :func:`stream_inputs`); a later batch wins.

    Only the partitions a batch falls in are rewritten.  A batch that is repeated
    after a failure gives the same table."""
    part = entry_day(keys[0]) if partition is None else partition

    def merge(batch: DataFrame, _: int) -> None:
        upsert_files(path, batch, list(keys), part, list(order), bounds="ts" if "ts" in batch.columns else None)

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def day_of(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def folders_of_days(spark: SparkSession, timeline: str, days: DataFrame) -> DataFrame:
    """The folders of the stored timeline that may hold entries of ``days`` (column date)."""
    known = folder_bounds(spark, timeline)
    first, last = F.to_date("low"), F.to_date("high")
    spread = known.where("low is not null").select("part", F.explode(F.sequence(first, last)).alias("_day"))
    return spread.join(days.select(F.to_date("date").alias("_day")), "_day", "left_semi").select("part").distinct()


def recount_days(spark: SparkSession, timeline: str, days: DataFrame, kind: str = "entry_type_id") -> DataFrame:
    """Who was active on each of ``days``, by type, as bitmaps: (day, date, kind, bucket, records, people).

    Only the folders that hold such days are read.  A day that has no entries (any more) gets
    one row without records, which takes the place of what was counted before."""
    names = materialize(folders_of_days(spark, timeline, days), "day-folders")
    rows = spark.read.parquet(timeline).join(names.where("part >= 'p-'"), "part", "left_semi").withColumn("date", day_of())
    counted = people_bitmaps(rows.join(days, "date", "left_semi"), ["date", kind])
    whole = days.join(counted, "date", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return whole.select(F.concat(F.lit("d-"), "date").alias("day"), "date", kind, "bucket", "records", "people")


def read_statistics(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Records and distinct people of the statistics at ``path`` by any of date and the type,
    or in total: or-ed from the bitmaps of the days."""
    return roll_up(spark.read.parquet(path).where("records > 0"), by)


def stream_statistics(
    rows: DataFrame,
    timeline: str,
    path: str,
    checkpoint: str,
    order: list[str],
    kind: str = "entry_type_id",
    keys: list[str] = ("id",),
    partition: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Every micro-batch written over the timeline at ``timeline``, and the days it touched
    counted again into ``path``, a folder per day, exact whatever the order in which entries
    arrive (read it by :func:`read_statistics`).

    A day an entry is moved away from counts as touched.  The days' folders are replaced when
    all of them are written; other days are neither read nor written.  Repeating a batch gives
    the same tables, also after a failure between the timeline and the statistics."""
    part = entry_day(keys[0]) if partition is None else partition

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch.withColumn("_part", F.concat(F.lit("p-"), part)), "batch")
        day = day_of().alias("date")
        days = batch.select(day)
        stored = read_files(spark, timeline)
        if stored is not None:
            # An id's folder follows from the id: the versions on file are in the batch's folders.
            names = batch.select(F.col("_part").alias("part")).where("part >= 'p-'").distinct()
            before = stored.join(names, "part", "left_semi").join(batch.select(*keys).distinct(), list(keys), "left_semi")
            days = days.unionByName(before.select(day))
        days = materialize(days.where("date is not null").distinct(), "days")
        previous = read_files(spark, f"{timeline}/_touched")
        if previous is not None:  # a batch that failed half way: its days are counted as well
            days = materialize(days.unionByName(previous.select("date")).distinct(), "days")
        days.write.mode("overwrite").parquet(f"{timeline}/_touched")
        upsert_files(timeline, batch.drop("_part"), list(keys), part, list(order), bounds="ts")
        counted = recount_days(spark, timeline, days, kind)
        ready = counted.hint("rebalance", "day")
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        days.limit(0).write.mode("overwrite").parquet(f"{timeline}/_touched")

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
