"""JSON lines, relaxed: one object per line, or a header array followed by value arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rollcall.session import scratch_path
from rollcall.sources.delimited import numbered_lines

# What Spark's JSON reader accepts beyond strict JSON.
RELAXED = {
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowComments": "true",
    "allowNonNumericNumbers": "true",
    "allowNumericLeadingZeros": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}


# A text in quotes or a comment, kept as it is; or what Spark's reader refuses: a comma before
# a closing bracket, and a plus before a number.
_SCANNED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|/\*.*?\*/|//.*$)|,(?=(?:\s|/\*.*?\*/)*[}\]])|(?<=[\[:,\s])\+(?=\d)"""


def strict_line(line: Column) -> Column:
    """A line of relaxed JSON without trailing commas and leading plus signs; the same
    characters inside of texts and comments stay."""
    return F.regexp_replace(line, _SCANNED, "$1")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line.  With a schema the files are read once; without one they are put
    aside with the spelling Spark reads, which it does an extra time to find the columns."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(strict_line(F.col("value")).alias("value"))
    options = RELAXED | {"mode": "FAILFAST"}
    if schema is None:
        aside = scratch_path(spark, "json-lines")
        lines.write.text(aside)
        return spark.read.options(**options).json(aside)
    return lines.select(F.from_json("value", schema, options).alias("v")).select("v.*")


def read_jsonl_header(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The first line of each file names the columns, later lines hold the values.

    Each file is read by its own header.  Values come back as strings.  ``columns``
    names the columns wanted; without it they are taken from the headers.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    cells = lines.select("path", "line", F.from_json(strict_line(F.col("value")), "array<string>", RELAXED).alias("cells"))
    headers = cells.where(F.col("line") == 1).select("path", F.col("cells").alias("names"))
    if columns is None:
        found = headers.select(F.explode("names").alias("n")).distinct().orderBy("n").collect()
        first = headers.orderBy("path").first()
        order = list(first["names"]) if first else []
        columns = order + [r["n"] for r in found if r["n"] not in order]
    rows = cells.where("line is null or line > 1").join(headers, "path")
    def value(name: str):
        place = F.array_position("names", name)
        return F.when(place > 0, F.get("cells", (place - 1).cast("int"))).alias(name)

    return rows.select(*[value(name) for name in columns])


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, mode: str = "error") -> None:
    """One object per line; null fields are left out."""
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").option("ignoreNullFields", True).json(path)
