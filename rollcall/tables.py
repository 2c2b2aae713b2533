"""Access to a folder that holds one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.session import configure


class Tables:
    """``Tables(spark, "/data").orders`` reads ``/data/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def named(self, *names: str) -> dict[str, DataFrame]:
        return {name: self[name] for name in names}
