"""Lenient typing of raw text, defaults, and checks against declared columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rollcall.functions.dates import clean_timestamp

# Declared type names, the Spark type that holds each, whether the
# column may be null, and the value used for a missing one when it may not.
TYPES: dict[str, tuple[str, bool, Any]] = {
    "id": ("bigint", False, 0),
    "person_id": ("bigint", False, 0),
    "foreign_id": ("bigint", True, None),
    "id_string": ("string", False, ""),
    "hash": ("string", False, ""),
    "id_uuid": ("string", False, ""),
    "foreign_uuid": ("string", True, None),
    "uuid": ("string", True, None),
    "string": ("string", True, None),
    "tinyint": ("tinyint", True, None),
    "smallint": ("smallint", True, None),
    "int": ("int", True, None),
    "bigint": ("bigint", True, None),
    "currency": ("decimal(19,2)", True, None),
    "decimal": ("decimal(19,4)", True, None),
    "double": ("double", True, None),
    "boolean": ("boolean", True, None),
    "text": ("string", True, None),
    "url": ("string", True, None),
    "json": ("string", True, None),
    "created_at": ("timestamp", False, None),
    "modified_at": ("timestamp", False, None),
    "date": ("date", True, None),
    "datetime": ("timestamp", True, None),
    "timestamp": ("timestamp", True, None),
    "time": ("string", True, None),
    "enum": ("string", True, None),
}

# Character limits of the bounded text types.
LENGTHS = {"string": 255, "id_string": 64, "hash": 64, "id_uuid": 36, "foreign_uuid": 36, "uuid": 36}

ZERO = {"date": "1970-01-01", "timestamp": "1970-01-01 00:00:00"}


@dataclass(frozen=True)
class Declared:
    """A declared column: type name plus what deviates from the type's defaults."""

    type: str
    nullable: bool | None = None
    default: Any = None
    length: int | None = None
    values: tuple[str, ...] = ()

    @property
    def spark_type(self) -> str:
        return TYPES[self.type][0]

    @property
    def may_be_null(self) -> bool:
        return TYPES[self.type][1] if self.nullable is None else self.nullable

    @property
    def blank(self) -> Column:
        """What stands in for a missing value."""
        if self.default is not None:
            return F.lit(self.default).cast(self.spark_type)
        if self.type in ("created_at", "modified_at"):
            return F.current_timestamp()
        if self.may_be_null:
            return F.lit(None).cast(self.spark_type)
        zero = TYPES[self.type][2]
        if zero is None:
            zero = "" if self.spark_type == "string" else ZERO.get(self.spark_type, 0)
        return F.lit(zero).cast(self.spark_type)


def declare(schema: dict[str, Any]) -> dict[str, Declared]:
    """``{"amount": "currency", "kind": {"type": "enum", "values": [...]}}`` to Declared columns."""
    out = {}
    for name, spec in schema.items():
        if isinstance(spec, Declared):
            out[name] = spec
        elif isinstance(spec, str):
            out[name] = Declared(spec)
        else:
            out[name] = Declared(**{**spec, "values": tuple(spec.get("values") or ())})
        if out[name].type not in TYPES:
            raise ValueError(f"unknown type {out[name].type} for {name}")
        if out[name].type == "enum" and not out[name].values:
            raise ValueError(f"enum column {name} needs values")
    return out


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def _text(name: str) -> Column:
    """The cell as text; '' and NULL count as missing."""
    raw = F.col(f"`{name}`").cast("string")
    return F.when((raw == "") | (raw == "NULL"), F.lit(None)).otherwise(raw)


def as_number(text: Column) -> Column:
    return F.regexp_replace(text, "[,$]", "")


def as_boolean(text: Column) -> Column:
    """Numbers by value; words are true if they contain y or t."""
    number = as_number(text).try_cast("double")
    word = F.lower(text)
    return F.when(number.isNotNull(), number != 0).otherwise(word.contains("y") | word.contains("t"))


def cut(text: Column, length: int | None, policy: str = "keep") -> Column:
    """Over-long text: ``keep`` it, ``fail`` the job, or ``cut`` it on request."""
    if not length or policy == "keep":
        return text
    if policy == "cut":
        return F.left(text, F.lit(length))
    if policy == "fail":
        message = F.concat(F.lit(f"value longer than {length}: "), text)
        return F.when(F.length(text) > length, F.raise_error(message).cast("string")).otherwise(text)
    raise ValueError(f"unknown over-length policy {policy}")


def whole_cast(value: Column, kind: str) -> Column:
    """Cast that loses nothing: a value the type cannot hold fails the job.

    Whole numbers may be written 5.0 or 1e3, and fractions of a second after a comma."""
    text = value.cast("string")
    if kind in ("bigint", "int", "smallint", "tinyint"):
        read = F.coalesce(value.try_cast(kind), text.try_cast("decimal(38,10)").try_cast(kind))
    elif kind in ("timestamp", "date"):
        read = F.coalesce(value.try_cast(kind), F.translate(text, ",", ".").try_cast(kind))
    else:
        read = value.try_cast(kind)
    told = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(kind)
    return F.when(value.isNotNull() & read.isNull(), told).otherwise(read)


def coerced(df: DataFrame, name: str, to: Declared, policy: str = "keep") -> Column:
    kind, field = to.spark_type, df.schema[name].dataType
    if isinstance(field, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(F.col(f"`{name}`")), to.blank).alias(name)
    text = _text(name)
    if kind in ("int", "bigint", "smallint"):
        value = F.round(as_number(text).try_cast("decimal(38,6)"), 0).try_cast(kind)
    elif kind == "tinyint":
        value = F.coalesce(as_number(text).try_cast("tinyint"), as_boolean(text).cast("tinyint"))
    elif kind == "boolean":
        value = as_boolean(text)
    elif kind == "double" or kind.startswith("decimal"):
        # The leading number counts; text without one is 0, as long as there is text.
        lead = F.regexp_extract(as_number(text), NUMBER, 0)
        value = F.when(text.isNotNull(), F.coalesce(lead.try_cast(kind), F.lit(0).cast(kind)))
    elif kind == "date":
        value = F.to_date(clean_timestamp(text))
    elif kind == "timestamp":
        value = clean_timestamp(text)
    elif to.type == "time":
        value = F.date_format(F.concat(F.lit("1970-01-01 "), text).try_cast("timestamp"), "HH:mm:ss")
    elif to.type == "enum":
        value = F.when(text.isin(*to.values), text)
    else:
        value = cut(text, to.length or LENGTHS.get(to.type), policy)
        if to.type in ("uuid", "id_uuid", "foreign_uuid"):
            value = F.lower(value)
    return F.coalesce(value, to.blank).alias(name)


def coerce(df: DataFrame, schema: dict[str, Any], policy: str = "keep") -> DataFrame:
    """The declared columns typed leniently, the others untouched; one projection."""
    declared = declare(schema)
    return df.select(
        *[coerced(df, c, declared[c], policy) if c in declared else F.col(f"`{c}`") for c in df.columns]
    )


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Missing, empty, zero and false values replaced; missing columns added."""
    out = {}
    for name, value in defaults.items():
        if name not in df.columns:
            out[name] = F.lit(value)
            continue
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.StringType):
            falsy = c.isNull() | (c == "")
        elif isinstance(kind, T.BooleanType):
            falsy = c.isNull() | ~c
        elif isinstance(kind, T.NumericType):
            falsy = c.isNull() | (c == 0)
        else:
            falsy = c.isNull()
        out[name] = F.when(falsy, F.lit(value).cast(kind)).otherwise(c)
    return df.withColumns(out)


def conform(df: DataFrame, schema: dict[str, Any], policy: str = "keep") -> DataFrame:
    """Exactly the declared columns, typed; columns ``df`` lacks hold their default."""
    declared = declare(schema)
    return df.select(
        *[coerced(df, c, d, policy) if c in df.columns else d.blank.alias(c) for c, d in declared.items()]
    )


def drift(df: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """One row per declared or present column: how the data differs from the declaration.

    ``blanks`` counts cells without a value, ``rejected`` cells whose value the
    declared type cannot hold.  One pass over the data.
    """
    declared = declare(schema)
    counts, rows = [], []
    for i, name in enumerate(dict.fromkeys([*declared, *df.columns])):
        want = declared.get(name)
        have = df.schema[name].dataType.simpleString() if name in df.columns else None
        if want is None:
            state = "undeclared"
        elif have is None:
            state = "missing"
        else:
            state = "same" if have == want.spark_type else "type"
        if have is not None:
            nested = isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType))
            text = F.to_json(F.col(f"`{name}`")) if nested else _text(name)
            counts.append(F.count_if(text.isNull()).alias(f"_blank{i}"))
            if want is None or nested:
                lost = F.lit(False)
            elif want.spark_type == "double" or want.spark_type.startswith("decimal"):
                lost = text.isNotNull() & as_number(text).try_cast(want.spark_type).isNull()
            else:
                open_type = Declared(want.type, nullable=True, values=want.values, length=want.length)
                lost = text.isNotNull() & coerced(df, name, open_type, "keep").isNull()
            counts.append(F.count_if(lost).alias(f"_lost{i}"))
        rows.append((name, want.spark_type if want else None, have, state, i))
    one = df.agg(*counts)

    def text_or_null(value: str | None) -> Column:
        return F.lit(value).cast("string")

    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                text_or_null(want).alias("declared"),
                text_or_null(have).alias("actual"),
                F.lit(state).alias("state"),
                (F.col(f"_blank{i}") if have else F.lit(None).cast("bigint")).alias("blanks"),
                (F.col(f"_lost{i}") if have else F.lit(None).cast("bigint")).alias("rejected"),
            )
            for name, want, have, state, i in rows
        ]
    )
    return one.select(F.inline(entries))


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

TIMELINE_COLUMNS = ("id", "ts", "person_id", "entry_type_id", "source_code_id")


def missing_report(df: DataFrame, columns: tuple[str, ...] = TIMELINE_COLUMNS) -> DataFrame:
    """Records, rows without a UUID id, and nulls per required column; one pass."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns {', '.join(absent)}")
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.coalesce(F.col(columns[0]).rlike(UUID), F.lit(False))).alias("bad_ids"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def require_timeline(df: DataFrame, columns: tuple[str, ...] = TIMELINE_COLUMNS) -> DataFrame:
    """The same rows; the job that uses them fails on the first row that is not a
    complete timeline entry.  The check rides along and costs no pass of its own."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns {', '.join(absent)}")
    key = F.col(columns[0])
    whole = F.lit(True)
    for c in columns[1:]:
        whole = whole & F.col(c).isNotNull()
    checked = (
        F.when(~F.coalesce(key.rlike(UUID), F.lit(False)), F.raise_error(F.lit("timeline rows need a uuid id")).cast("string"))
        .when(~whole, F.raise_error(F.concat(F.lit("timeline row lacks a required value: "), key)).cast("string"))
        .otherwise(key)
    )
    return df.withColumn(columns[0], checked)
