"""Expression text in the audience tool's spelling, made readable for Spark SQL.

Expressions stay Spark SQL: Spark parses, checks and optimizes them.  What
differs between the two is spelling, so ``spark_text`` swaps words outside of
quoted text, and ``register`` adds a handful of SQL functions (which Spark
inlines, like views) for names whose meaning differs.
"""

from __future__ import annotations

import re
from functools import wraps

from pyspark.sql import Column, SparkSession, functions as F

from rollcall.functions.dates import UNITS

# Function names that need another name in Spark.
FUNCTION_NAMES = {
    "getdate": "current_timestamp",
    "average": "avg",
    "ifnull": "coalesce",
    "date": "to_date",
    "day": "to_date",
    "week": "rollcall_week",
    "month": "rollcall_month",
    "fiscal_year": "rollcall_fiscal_year",
    "day_of_year": "dayofyear",
    "day_of_fiscal_year": "rollcall_day_of_fiscal_year",
    "regexp_like": "rollcall_regexp_like",
    "fulltext_boolean": "rollcall_fulltext_boolean",
    "cast": "try_cast",
}

# Cast targets, by the Spark type that holds them.
CAST_TYPES = {"signed": "bigint", "unsigned": "decimal(20,0)", "char": "string", "datetime": "timestamp"}

# SQL functions for names whose result differs from Spark's own.
SQL_FUNCTIONS = [
    "rollcall_week(x timestamp) returns date return date_sub(to_date(x), dayofweek(x) - 1)",
    "rollcall_month(x timestamp) returns date return to_date(trunc(x, 'MONTH'))",
    "rollcall_fiscal_year(x timestamp, start string default '01-01') returns int return"
    " case when start = '01-01' then year(x) else"
    " year(date_sub(add_months(to_date(x), 13 - cast(substr(start, 1, 2) as int)),"
    " cast(substr(start, 4, 2) as int) - 1)) end",
    "rollcall_day_of_fiscal_year(x timestamp, start string default '01-01') returns int return"
    " case when start = '01-01' then dayofyear(x) else datediff(to_date(x),"
    " to_date(concat(year(date_sub(add_months(to_date(x), 13 - cast(substr(start, 1, 2) as int)),"
    " cast(substr(start, 4, 2) as int) - 1)) - 1, '-', start))) end",
    "rollcall_regexp_like(x string, pattern string) returns boolean return x rlike concat('(?i)', pattern)",
    r"rollcall_fulltext_boolean(x string, terms string) returns boolean return"
    r" forall(split(lower(terms), ' +'), t -> case"
    r" when startswith(t, '+') then array_contains(split(lower(x), '[^\\p{L}\\p{N}_]+'), substr(t, 2))"
    r" when startswith(t, '-') then not array_contains(split(lower(x), '[^\\p{L}\\p{N}_]+'), substr(t, 2))"
    r" else true end)"
    r" and (contains(terms, '+') or not exists(split(terms, ' +'), t -> not startswith(t, '-'))"
    r" or arrays_overlap(split(lower(x), '[^\\p{L}\\p{N}_]+'), split(lower(terms), ' +')))",
    "xor(a boolean, b boolean) returns boolean return a <> b",
    "rollcall_time(x string) returns string return date_format(try_cast(x as timestamp), 'HH:mm:ss')",
    "rollcall_plus(x timestamp, span interval) returns timestamp return x + span",
    "rollcall_minus(x timestamp, span interval) returns timestamp return x - span",
]

_UNIT = "|".join(UNITS)
_NEST = r"(?:[^()]|\([^()]*\))*?"
_SPELLING = re.compile(
    r"""(?P<keep>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)"""
    r"""|(?<![\w\])])\[(?P<bracket>[A-Za-z_][^\]]*)\]"""
    r"""|(?P<and>&&)|(?P<or>\|\|)"""
    rf"""|\binterval\s+(?P<amount>[\w.`]+|'[^']*'|\([^()]*\))\s+(?P<unit>{_UNIT})\b"""
    rf"""|\bdate_(?P<move>add|sub)\s*\((?={_NEST},\s*interval\b)"""
    rf"""|\bas\s+(?P<type>{"|".join(CAST_TYPES)})\s*(?=\))"""
    rf"""|(?<![\w.`])(?P<name>{"|".join(FUNCTION_NAMES)})\s*\(""",
    re.IGNORECASE,
)


def _respell(found: re.Match) -> str:
    if found["keep"]:
        return found["keep"]
    if found["bracket"]:
        return f"`{found['bracket']}`"
    if found["and"]:
        return " and "
    if found["or"]:
        return " or "
    if found["unit"]:
        amount = found["amount"].strip("'")
        unit = found["unit"].lower()
        slot, factor = UNITS[unit]
        slots = dict.fromkeys(("years", "months", "weeks", "days", "hours", "mins"), "0")
        if slot == "secs":
            slots[slot] = f"cast(({amount}) * {factor:.6f} as decimal(18,6))"
        else:
            slots[slot] = f"cast(({amount}) * {factor} as int)"
        return f"make_interval({', '.join(slots.values())})"
    if found["move"]:
        return "rollcall_plus(" if found["move"].lower() == "add" else "rollcall_minus("
    if found["type"]:
        return f"as {CAST_TYPES[found['type'].lower()]}"
    return FUNCTION_NAMES[found["name"].lower()] + "("


_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|\[[A-Za-z_][^\]]*\]|/\*.*?\*/|--[^\n]*""", re.DOTALL)
_INNERMOST = re.compile(r"(?P<cast>\bcast\s*)?\((?P<inside>[^()]*)\)", re.IGNORECASE)
_TIME = re.compile(r"(.*)\bas\s+time\s*", re.IGNORECASE | re.DOTALL)
# What ends a side of xor, which binds looser than ``and`` and tighter than ``or``.
_SIDES = re.compile(r"(,|\|\||\b(?:or|case|when|then|else|end|as|distinct)\b)", re.IGNORECASE)
_XOR = re.compile(r"\bxor\b", re.IGNORECASE)
_WORDS = "null|true|false|exists|case|in|between|like|rlike|regexp_like|cast|xor"
_DENIED = re.compile(
    rf"(?<!\bis )(?:\bnot\s+|!(?!=)\s*)(?!(?:{_WORDS})\b)([A-Za-z_][\w.\x00]*|\x00[\w.\x00]*|\d+(?:\.\d+)?)"
    r"(?=\s*(?:$|[),]|&&|\|\||(?:and|or|xor|then|when|else|end)\b))",
    re.IGNORECASE,
)


def _exclusive(text: str) -> str:
    """``a xor b`` in a text without parentheses as ``((a) <> (b))``; ``xor(a, b)`` is left to the function."""
    parts = _SIDES.split(text)
    for k, part in enumerate(parts):
        sides = _XOR.split(part)
        if len(sides) < 2 or not sides[0].strip():
            continue
        joined = sides[0].strip()
        for side in sides[1:]:
            joined = f"(({joined}) <> ({side.strip()}))"
        parts[k] = f" {joined} "
    return "".join(parts)


def _levels(text: str) -> str:
    """What depends on the parentheses around it, from the innermost ones outwards: xor, and
    ``cast(x as time)``, which is the time of day of a timestamp or a text."""
    if not re.search(r"\bxor\b|\bas\s+time\b", text, re.IGNORECASE):
        return text
    kept: list[str] = []

    def keep(found: re.Match) -> str:
        lead, inside = found["cast"] or "", found["inside"]
        timed = _TIME.fullmatch(inside) if lead else None
        if timed:
            lead, inside = "rollcall_time", timed[1].strip()
        kept.append(f"{lead}({_exclusive(inside)})")
        return f"\x01{len(kept) - 1}\x01"

    while True:
        less = _INNERMOST.sub(keep, text)
        if less == text:
            break
        text = less
    text = _exclusive(text)
    while "\x01" in text:
        text = re.sub("\x01(\\d+)\x01", lambda found: kept[int(found[1])], text)
    return text


def spark_text(text: str) -> str:
    """``text`` with what Spark spells differently swapped, quoted text and comments untouched."""
    kept: list[str] = []

    def keep(found: re.Match) -> str:
        if found[0].startswith(("/*", "--")):
            return " "
        kept.append(found[0])
        return f"\x00{len(kept) - 1}\x00"

    bare = _QUOTED.sub(keep, text)
    bare = _levels(_DENIED.sub(r"not try_cast(\1 as boolean)", bare))
    text = re.sub("\x00(\\d+)\x00", lambda found: kept[int(found[1])], bare)
    return _SPELLING.sub(_respell, text)


ANSI = "spark.sql.ansi.enabled"


def tool_arithmetic(fn):
    """Inside ``fn`` expressions are resolved as the audience tool reads them: division by zero
    and values that do not fit give null.  Spark settles that when a column is put into a
    DataFrame, so it holds for what ``fn`` returns and for nothing else."""

    @wraps(fn)
    def inner(*args, **kwargs):
        conf = SparkSession.active().conf
        before = conf.get(ANSI)
        conf.set(ANSI, "false")
        try:
            return fn(*args, **kwargs)
        finally:
            conf.set(ANSI, before)

    return inner


def register(spark: SparkSession) -> None:
    """Make the SQL functions that ``spark_text`` refers to known to the session."""
    for definition in SQL_FUNCTIONS:
        spark.sql(f"create or replace temporary function {definition}")


def expression(text: str) -> Column:
    """A column from expression text.  Put it into a DataFrame inside of :func:`tool_arithmetic`
    (query objects, lookups and exports do) if division by zero is to be null."""
    spelled = spark_text(text)
    if "rollcall_" in spelled or re.search(r"\bxor\s*\(", spelled, re.IGNORECASE):
        session = SparkSession.active()
        if not session.catalog.functionExists("rollcall_week"):
            register(session)
    return F.expr(spelled)


# --- the same helpers for people who write columns rather than text ----------------


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def divide(a: Column | str, b: Column | str) -> Column:
    """Null on division by zero."""
    return F.try_divide(_col(a), _col(b))


def xor(a: Column, b: Column) -> Column:
    return a != b


def is_true(value: Column | str) -> Column:
    return _col(value).eqNullSafe(F.lit(True))


def is_false(value: Column | str) -> Column:
    return _col(value).eqNullSafe(F.lit(False))


def first_present(*values: Column | str) -> Column:
    return F.coalesce(*[_col(v) for v in values])


def cast_as(value: Column | str, name: str) -> Column:
    """Lenient cast by the tool's type names (signed, char, datetime …)."""
    if name.lower() == "time":
        return F.date_format(_col(value).cast("string").try_cast("timestamp"), "HH:mm:ss")
    return _col(value).try_cast(CAST_TYPES.get(name.lower(), name))


def cast_int(value: Column | str) -> Column:
    return _col(value).try_cast("bigint")


def generated_uuid() -> Column:
    return F.uuid()
