"""Text, hash and e-mail helpers as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_lookup(value: Column | str) -> Column:
    """The form values are matched in: trimmed and lower case."""
    return F.lower(F.trim(_col(value)))


def locate(needle: str, value: Column | str, start: int = 1) -> Column:
    return F.locate(needle, _col(value), start)


def matches(value: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression match."""
    return _col(value).rlike(f"(?i){pattern}")


def words(value: Column | str) -> Column:
    return F.split(F.lower(_col(value)), WORD_BREAK)


def fulltext_boolean(value: Column | str, query: str) -> Column:
    """``+must -never other``: every + word, no - word, and one of the others if no + is given."""
    terms = [t.lower() for t in query.split()]
    bag = words(value)
    must = [t[1:] for t in terms if t.startswith("+")]
    never = [t[1:] for t in terms if t.startswith("-")]
    either = [t for t in terms if t[0] not in "+-"]
    test = F.lit(True)
    for term in must:
        test = test & F.array_contains(bag, term)
    if either and not must:
        test = test & F.arrays_overlap(bag, F.array(*[F.lit(t) for t in either]))
    for term in never:
        test = test & ~F.array_contains(bag, term)
    return test


def hash_v1(value: Column | str) -> Column:
    """Identity hash: SHA-256 of the trimmed, lower-case text ('' for null)."""
    return F.sha2(F.lower(F.trim(F.coalesce(_col(value), F.lit("")))), 256)


def sha_upper(*values: Column | str) -> Column:
    return F.upper(F.sha1(F.concat(*[_col(v) for v in values])))


def email_domain(value: Column | str) -> Column:
    """What follows the last @, lower case; all of it without an @; '' for null."""
    return F.lower(F.substring_index(F.coalesce(_col(value), F.lit("")), "@", -1))


def email_domain_first(value: Column | str) -> Column:
    """What follows the first @ (the rule used inside queries)."""
    c = _col(value)
    return F.coalesce(F.lower(F.substr(c, F.locate("@", c) + 1)), F.lit(""))


def normalize_phone(value: Column | str) -> Column:
    """Ten digits, or eleven from 1, become ``+1…``; other international numbers
    keep their digits after ``+``; null for what is too short or long to be one."""
    raw = F.trim(_col(value))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    size = F.length(digits)
    return (
        F.when(raw.startswith("+") & size.between(8, 15), F.concat(F.lit("+"), digits))
        .when(size == 10, F.concat(F.lit("+1"), digits))
        .when((size == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    )


def clean_column_name(name: str) -> str:
    return re.sub("[^a-z0-9_]", "_", name.lower())


def clean_columns(df: DataFrame) -> DataFrame:
    """Columns under their cleaned names; of two that collide the first stays."""
    chosen: dict[str, str] = {}
    for name in df.columns:
        chosen.setdefault(clean_column_name(name), name)
    return df.select(*[F.col("`%s`" % old.replace("`", "``")).alias(new) for new, old in chosen.items()])
