"""Stored input files: which input and plugin a file belongs to follows from its path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.operators.clean import UUID

FILE = "_file"


def with_path(df: DataFrame) -> DataFrame:
    """The path each row was read from (works on any file source, batch or stream)."""
    return df.withColumn(FILE, F.col("_metadata.file_path"))


def input_from_path(df: DataFrame, strict: bool = True) -> DataFrame:
    """Adds input_id (the parent folder, a UUID), and plugin_id or remote_plugin_id
    (the fourth part from the end: a UUID, or ``x:remote id``)."""
    parts = F.split(FILE, "/")
    parent, plugin = F.element_at(parts, -2), F.element_at(parts, -4)
    told = F.raise_error(F.concat(F.lit("folder is not an input id: "), F.col(FILE))).cast("string")
    input_id = F.when(parent.rlike(UUID), parent)
    if strict:
        input_id = input_id.otherwise(told)
    return df.withColumns(
        {
            "input_id": input_id,
            "plugin_id": F.when(plugin.rlike(UUID), plugin),
            "remote_plugin_id": F.when(~plugin.rlike(UUID), F.element_at(F.split(F.url_decode(plugin), ":"), -1)),
        }
    )


def scan_stored_inputs(files: DataFrame, inputs: DataFrame | None = None, plugins: DataFrame | None = None) -> DataFrame:
    """Rows of stored files with input_id and plugin_id.

    The plugin is the one on record for the input; else the one the path names, by
    id or by remote id.  ``files`` is any file source just read.
    """
    rows = input_from_path(with_path(files))
    if inputs is not None:
        on_record = inputs.select(F.col("id").alias("input_id"), F.col("plugin_id").alias("_recorded"))
        rows = rows.join(on_record, "input_id", "left").withColumn("plugin_id", F.coalesce("_recorded", "plugin_id")).drop("_recorded")
    if plugins is not None:
        named = plugins.select(F.col("id").alias("_named"), "remote_plugin_id")
        rows = rows.join(named, "remote_plugin_id", "left").withColumn("plugin_id", F.coalesce("plugin_id", "_named")).drop("_named")
    return rows.drop(FILE, "remote_plugin_id")
