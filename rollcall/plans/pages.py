"""Pages far down an ordered result, without gathering the rows before them.

``offset`` with an order makes Spark collect offset + limit rows in one task.  Here the result
is laid out once by ranges of its order; the sizes of the ranges (one number each) say in
which of them a page lies, and only those are read and numbered.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rollcall.session import scratch_path


class Pages:
    """``df`` in the order of ``order``; any number of pages can be taken from it.

    Rows that are equal by ``order`` follow a hash of the row, so they spread over ranges as
    well, and all pages agree on their order.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        self.spark, self.columns = df.sparkSession, df.columns
        self.order = [*order, F.col("_tie").asc()]
        tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        self.path = scratch_path(self.spark, "pages")
        laid = tied.repartitionByRange(*self.order).withColumn("_range", F.spark_partition_id())
        laid.write.partitionBy("_range").parquet(self.path)
        self.schema = laid.schema
        self.sizes = {r["_range"]: r["n"] for r in self._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def page(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows after the first ``offset``, in order; fewer at the end."""
        ranges = sorted(self.sizes)
        ends = list(accumulate(self.sizes[r] for r in ranges))
        starts = {r: end - self.sizes[r] for r, end in zip(ranges, ends)}
        wanted = [r for r, end in zip(ranges, ends) if end > offset and starts[r] < offset + limit]
        rows = self._rows().where(F.col("_range").isin(wanted)) if wanted else self._rows().limit(0)
        start = F.lit(0)
        for r in wanted:
            start = F.when(F.col("_range") == r, starts[r]).otherwise(start)
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)) + start
        rows = rows.withColumn("_place", place).where((F.col("_place") > offset) & (F.col("_place") <= offset + limit))
        return rows.orderBy("_place").limit(limit).select(*[f"`{c}`" for c in self.columns])
