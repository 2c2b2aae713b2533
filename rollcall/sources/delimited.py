"""Delimited text: every value a string, headers trimmed, bad lines optional."""

from __future__ import annotations

import csv
import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

BAD = "_bad_line"


def delimiter_for(path: str) -> str:
    """Tab for .txt (also .txt.gz), comma otherwise."""
    name = path.rstrip("/").removesuffix(".gz")
    return "\t" if os.path.splitext(name)[1] == ".txt" else ","


def _kept(names: list[str]) -> list[tuple[int, str]]:
    """Position and trimmed name of the columns that have a name; the first of two wins."""
    out: dict[str, int] = {}
    for i, name in enumerate(names):
        clean = (name or "").lstrip("﻿").strip().strip("﻿")
        if clean:
            out.setdefault(clean, i)
    return [(i, name) for name, i in out.items()]


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, path, line): lines of text with their place in the file.

    Spark splits large files, so only lines of a file's first split get a number
    (from 1); lines of later splits have null.  That is enough to find a header.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    first = lines.where("_start = 0").groupBy("path").agg(F.min("_place").alias("_first"))
    return lines.join(first, "path", "left").select(
        "value", "path", F.when(F.col("_start") == 0, F.col("_place") - F.col("_first") + 1).alias("line")
    )


def _headers(spark: SparkSession, path: str, line: int) -> list[tuple[str, list[str]]]:
    """Each distinct header line, and the files it heads.

    The driver lists the files to plan the read anyway; here they come grouped by header.
    A file that ends before its header line fails the read, an empty file has no rows.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("line").isNotNull()).groupBy("path").agg(
        F.max(F.when(F.col("line") == line, F.col("value"))).alias("head")
    )
    found = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    found = sorted((r for r in found), key=lambda r: r["paths"][0])
    without = [r for r in found if r["head"] is None]
    if without:
        raise ValueError(f"{unquote(without[0]['paths'][0])} has no line {line}")
    if not found:
        raise ValueError(f"{path} is empty")
    return [(r["head"], [unquote(x) for x in r["paths"]]) for r in found]


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    skip: int | None = None,
    relax: bool = False,
    escape: str | None = None,
    skip_bad_lines: bool = False,
    multi_line: bool = False,
    encoding: str | None = None,
) -> DataFrame:
    """CSV or tab-delimited text, gzipped or not.

    Each file is read by its own header, so files may order their columns differently or
    lack some; the result has all columns, in the order they are met, null where a file has
    none.  All values are strings; blank cells are null, blank rows and columns without a
    name are dropped.  ``skip`` is the 1-based line the header is on.  ``relax``
    accepts rows with missing or surplus cells; otherwise such a row fails the
    read, unless ``skip_bad_lines`` leaves it out.  ``multi_line`` (line breaks
    inside quotes) makes Spark read each file in one task, so it is off by default.
    """
    sep = delimiter or delimiter_for(path)
    options = {"sep": sep, "quote": '"', "escape": escape or '"', "mode": "PERMISSIVE"}
    if encoding:
        options["encoding"] = encoding
    out = None
    for head, files in _headers(spark, path, skip or 1):
        names = next(csv.reader([head], delimiter=sep))
        schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{BAD} string"])
        parsed = {**options, "columnNameOfCorruptRecord": BAD}
        if skip and skip > 1:
            lines = numbered_lines(spark, files)
            # Lines above the body become null rather than filtered: what is read from them
            # must never be looked at, however Spark orders the filters.
            body = lines.select(F.when(F.col("line").isNull() | (F.col("line") > skip), F.col("value")).alias("value"))
            rows = body.where(F.trim("value") != "").select(F.from_csv("value", schema, parsed).alias("r")).select("r.*")
        else:
            reader = spark.read.options(**parsed).option("header", True).option("enforceSchema", True)
            rows = reader.option("multiLine", multi_line).schema(schema).csv(files)
        rows = _named(rows, names, relax, skip_bad_lines)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _named(rows: DataFrame, names: list[str], relax: bool, skip_bad_lines: bool) -> DataFrame:
    """Cells under their names; what is to be done with bad and blank lines."""
    if skip_bad_lines:
        rows = rows.where(F.col(BAD).isNull())
    elif not relax:
        told = F.raise_error(F.concat(F.lit("bad line: "), F.col(BAD))).cast("string")
        rows = rows.withColumn("c0", F.when(F.col(BAD).isNotNull(), told).otherwise(F.col("c0")))
    some = F.lit(False)
    for i in range(len(names)):
        some = some | (F.coalesce(F.col(f"c{i}"), F.lit("")) != "")
    return rows.where(some).select(*[F.col(f"c{i}").alias(name) for i, name in _kept(names)])


def write_delimited(df: DataFrame, path: str, gzip: bool = False, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option(
        "compression", "gzip" if gzip else "none"
    ).csv(path)
