"""Parquet: name-tolerant reading, and the typed file of an identified input."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rollcall.functions.text import clean_column_name, email_domain
from rollcall.operators.clean import whole_cast
from rollcall.operators.profile import infer_types
from rollcall.session import materialize
from rollcall.sources.delimited import write_delimited

# Columns every identified file starts with, and their types.
IDENTIFIED = {
    "id": "string",
    "ts": "timestamp",
    "entry_type_id": "int",
    "person_id": "bigint",
    "source_code_id": "bigint",
}

# What identification replaces, so the file does not repeat it.
REPLACED = (
    "remote_entry_uuid",
    "input_id",
    "identifiers",
    "entry_type",
    "source_code",
    "remote_input_id",
    "remote_input_name",
)

# Column types of a profile and the Parquet type each is stored as.
STORED_AS = {
    "date": "timestamp",
    "datetime": "timestamp",
    "boolean": "boolean",
    "int": "bigint",
    "decimal": "double",
    "double": "double",
    "uuid": "string",
    "string": "string",
}

HASHES = ("email_hash_v1", "phone_hash_v1")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Only the named columns are read.  A name matches exactly, or a column whose
    cleaned name it is (``upper_case_content`` finds ``Upper Case Content``)."""
    df = spark.read.parquet(path)
    if columns:
        cleaned: dict[str, str] = {}
        for name in df.columns:
            cleaned.setdefault(clean_column_name(name), name)
        chosen = []
        for name in columns:
            actual = name if name in df.columns else cleaned.get(clean_column_name(name))
            if actual is None:
                raise ValueError(f"no column {name} in {path}")
            chosen.append(F.col("`%s`" % actual.replace("`", "``")).alias(name))
        df = df.select(*chosen)
    return df.limit(limit) if limit else df


@dataclass(frozen=True)
class Written:
    path: str
    records: int
    min_ts: Any
    max_ts: Any


def identified_columns(df: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """The typed columns of an identified input: the fixed five, the e-mail domain if
    there is an e-mail, then the input's own columns by inferred type."""
    fixed = [F.col(c).cast(kind).alias(c) for c, kind in IDENTIFIED.items()]
    if "email" in df.columns:
        fixed.append(email_domain("email").alias("email_domain"))
    own = [c for c in df.columns if c not in IDENTIFIED and c not in REPLACED and c != "email_domain"]
    text = [f.name for f in df.schema.fields if f.name in own and f.dataType.simpleString() == "string"]
    kinds: dict[str, str] = {}
    if text:
        # One row per text column comes back to the driver.
        kinds = {r["name"]: STORED_AS[r["type"]] for r in infer_types(df.select(*text), hints).collect()}
    return df.select(*fixed, *[whole_cast(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in own])


def write_identified(df: DataFrame, path: str, hints: dict[str, str] | None = None) -> Written:
    """Gzipped Parquet with a bloom filter on ``ts``; returns records and time range."""
    spark = df.sparkSession
    df = materialize(df, "identified")  # read for its types and again for the file
    identified_columns(df, hints).write.option("compression", "gzip").option(
        "parquet.bloom.filter.enabled#ts", "true"
    ).parquet(path)
    found = spark.read.parquet(path).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
    return Written(path, *found)


def write_identified_csv(df: DataFrame, path: str, original: list[str]) -> Written:
    """The same as gzipped CSV: ids first, without identifiers, input id, and hashes
    the input did not bring along itself."""
    drop = {"identifiers", "input_id", *(h for h in HASHES if h not in original)}
    first = [c for c in IDENTIFIED if c in df.columns]
    rest = [c for c in df.columns if c not in drop and c not in first]
    seen = Observation()
    rows = df.select(*first, *[f"`{c}`" for c in rest])
    rows = rows.observe(seen, F.count(F.lit(1)).alias("records"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    write_delimited(rows, path, gzip=True)
    return Written(path, seen.get["records"], seen.get["low"], seen.get["high"])
