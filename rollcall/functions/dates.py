"""Date buckets, relative dates and lenient date parsing, all as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_ZONE = "America/New_York"

# Interval units and the make_interval slot (and factor) each fills.
UNITS = {
    "microsecond": ("secs", 1e-6),
    "millisecond": ("secs", 1e-3),
    "second": ("secs", 1),
    "minute": ("mins", 1),
    "hour": ("hours", 1),
    "day": ("days", 1),
    "week": ("weeks", 1),
    "month": ("months", 1),
    "quarter": ("months", 3),
    "year": ("years", 1),
}

# One-letter periods of a relative date.
PERIODS = {"y": "year", "Y": "year", "M": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def now() -> Column:
    return F.current_timestamp()


def interval(amount: Column | int, unit: str) -> Column:
    slot, factor = UNITS[unit.lower().removesuffix("s")]
    count = amount if isinstance(amount, Column) else F.lit(amount)
    if slot == "secs":
        count = (count * F.lit(factor)).cast("decimal(18,6)")
    else:
        count = (count * F.lit(factor)).cast("int")
    return F.make_interval(**{slot: count})


def shift(value: Column | str, amount: Column | int, unit: str) -> Column:
    """``value`` moved by ``amount`` units (negative moves back)."""
    return _col(value) + interval(amount, unit)


def day(value: Column | str) -> Column:
    return F.to_date(_col(value))


def week(value: Column | str) -> Column:
    """The Sunday that starts the week."""
    return F.date_sub(F.to_date(_col(value)), F.dayofweek(_col(value)) - 1)


def month(value: Column | str) -> Column:
    return F.trunc(_col(value), "MONTH")


def year(value: Column | str) -> Column:
    return F.year(_col(value))


def quarter_label(value: Column | str) -> Column:
    c = _col(value)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def quarter_start(value: Column | str) -> Column:
    return F.trunc(_col(value), "QUARTER")


def year_start(value: Column | str) -> Column:
    return F.date_format(F.trunc(_col(value), "YEAR"), "yyyy-MM-dd")


def month_name(value: Column | str) -> Column:
    return F.date_format(_col(value), "MMMM")


def short_date(value: Column | str) -> Column:
    return F.date_format(_col(value), "yyyyMMdd")


def _fiscal(start: str) -> tuple[int, int]:
    month_text, day_text = start.split("-")
    return int(month_text), int(day_text)


def fiscal_year(value: Column | str, start: str = "01-01") -> Column:
    """Fiscal years are named after the calendar year they end in; ``start`` is MM-DD."""
    first_month, first_day = _fiscal(start)
    if (first_month, first_day) == (1, 1):
        return year(value)
    moved = F.add_months(F.to_date(_col(value)), 13 - first_month)
    return F.year(F.date_sub(moved, first_day - 1))


def day_of_year(value: Column | str) -> Column:
    return F.dayofyear(_col(value))


def day_of_fiscal_year(value: Column | str, start: str = "01-01") -> Column:
    """Days since the fiscal year began, 0 on its first day (day of year for 01-01)."""
    if _fiscal(start) == (1, 1):
        return day_of_year(value)
    opened = F.to_date(F.concat((fiscal_year(value, start) - 1).cast("string"), F.lit(f"-{start}")))
    return F.datediff(F.to_date(_col(value)), opened)


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def in_zone(value: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    return F.from_utc_timestamp(_col(value), zone)


BUCKETS = {
    "NONE": lambda c: c,
    "DAY": day,
    "DATE": day,
    "WEEK": week,
    "MONTH": month,
    "YEAR": year,
    "FISCAL_YEAR": fiscal_year,
    "DAY_OF_YEAR": day_of_year,
    "DAY_OF_FISCAL_YEAR": day_of_fiscal_year,
}


def bucket_for_span(days: int) -> str:
    """Which date bucket keeps a chart over ``days`` days readable."""
    for limit, name in ((1200, "YEAR"), (365, "MONTH"), (180, "WEEK")):
        if days > limit:
            return name
    return "DAY"


_RELATIVE = re.compile(r"(?P<sign>[+-])(?P<amount>\d+)(?P<period>[YyMwdhms])(?P<snap>[.a-z]*)")


def _floor(value: Column, unit: str) -> Column:
    if unit == "week":
        return week(value).cast("timestamp")
    return F.date_trunc(unit, value)


def relative_bound(text: str | int | None, at: Column | None = None) -> Column | None:
    """A date bound as a column.

    ``-3M``, ``+2s``, ``-1d.start.month`` and ``-1d.end.day`` count from ``at``
    (now if not given); a whole number is epoch milliseconds; anything else is
    read as an ISO timestamp.  ``None`` and ``none`` mean no bound.
    """
    if text is None or text in ("", "none"):
        return None
    text = str(text)
    base = now() if at is None else at
    if re.fullmatch(r"-?\d+", text):
        return F.timestamp_millis(F.lit(int(text)))
    if text == "now":
        return base
    found = _RELATIVE.fullmatch(text)
    if not found:
        return F.lit(text).cast("timestamp")
    amount = int(found["amount"]) * (-1 if found["sign"] == "-" else 1)
    bound = shift(base, amount, PERIODS[found["period"]])
    snap = [part for part in found["snap"].split(".") if part]
    if not snap:
        return bound
    unit = snap[1] if len(snap) > 1 else "day"
    if snap[0] not in ("start", "end") or unit not in UNITS:
        raise ValueError(f"unknown relative date: {text}")
    floor = _floor(bound, unit)
    if snap[0] == "start":
        return floor
    return floor + interval(1, unit) - F.expr("interval 0.001 second")


def date_window(
    df: DataFrame,
    column: str,
    start: str | int | None = None,
    end: str | int | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Rows with ``start <= column < end``; bounds as in :func:`relative_bound`."""
    low, high = relative_bound(start, at), relative_bound(end, at)
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) < high)
    return df


# Two-digit years after this one are taken to be in the 1900s.
LAST_SHORT_YEAR = 68


def clean_timestamp(value: Column | str) -> Column:
    """Free-form date text to a timestamp; null for what is not a date.

    Understands month/year, month/day/year (years of two or four digits), a bare
    year, and whatever Spark reads as an ISO date or timestamp.
    """
    text = F.trim(_col(value))
    short = F.right(text, F.lit(2))
    century = F.when(short.try_cast("int") > LAST_SHORT_YEAR, "19").otherwise("20")
    opened = F.concat(F.left(text, F.length(text) - 2), century, short)
    full = F.when(text.rlike(r"^\d{1,2}/(\d{1,2}/)?\d{2}$"), opened).otherwise(text)
    return (
        F.when(full.rlike(r"^\d{1,2}/\d{4}$"), F.try_to_timestamp(F.concat(F.lit("1/"), full), F.lit("d/M/yyyy")))
        .when(full.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(full, F.lit("M/d/yyyy")))
        .otherwise(full.try_cast("timestamp"))
    )


def clean_date(df: DataFrame, field: str, target: str | None = None) -> DataFrame:
    """``field`` as an ISO date and time in UTC (or null), stored in ``target``."""
    iso = F.date_format(clean_timestamp(field), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.withColumn(target or field, iso)
