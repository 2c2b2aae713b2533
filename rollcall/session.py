"""Session settings, and the shared folder intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  All are runtime SQL settings, so they can be
# put on a session somebody else created.
RUNTIME_CONF = {
    # Dates and day buckets are UTC, as stored.
    "spark.sql.session.timeZone": "UTC",
    # Parquet timestamps without a zone are read as UTC instants, which keeps
    # comparisons free of casts and therefore pushed down to the scan.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # Re-plan on real sizes: coalesce small partitions, switch to a broadcast
    # join when a side turns out small, split a partition that one key fills.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Shuffle files of an action go when it ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rollcall")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Executors come and go, so intermediate tables must live where all of them
    can read.  Only a local session may fall back to a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="rollcall-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nothing has been written to yet."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/rollcall/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan behind it is
    cut, and a lost executor costs a re-read instead of a recomputation.  What was
    shuffled for it is not needed after that, and its files are removed."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables, once all that is made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        own = f"{scratch_root(spark)}/rollcall/{spark.sparkContext.applicationId}/".split(":", 1)[-1].lstrip("/")
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        folders = {path_of(x).getParent().toString() for x in table.inputFiles()}
        for folder in map(path_of, folders):
            if own not in folder.toString():
                raise ValueError(f"not an intermediate table: {folder.toString()}")
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
