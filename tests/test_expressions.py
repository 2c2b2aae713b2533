import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates, text
from rollcall.functions.expressions import expression, spark_text, tool_arithmetic


@pytest.fixture(scope="module")
def one(spark):
    return spark.sql("select 1 as x, 2 as y, 3 as z, cast(null as int) as n, timestamp'2024-02-07 10:30:00' as ts, 'a b' as `two words`")


def value(one, text_):
    return tool_arithmetic(lambda: one.select(expression(text_)))().first()[0]


@pytest.mark.parametrize(
    "text_, expected",
    [
        ("ifnull(x, y, z)", 1),
        ("ifnull(n, 1 + y, 2 + z)", 3),
        ("ifnull(n, null, z)", 3),
        ("1.0 + 0.3", 1.3),
        ("(x + y / 2) * 2", 4),
        ("x between 1 and 2", True),
        ("1 in (x, y, 4, 5, x * 3)", True),
        ("1 not in (x)", False),
        ("2 in (2)", True),
        ("concat(\"test\", 'me')", "testme"),
        ("case when x = 1 then \"test\" else 'hello' end", "test"),
        ("case y when 1 then 'one' when 2 then 'two' else 'other' end", "two"),
        ("if(1 = 1, null, 1)", None),
        ("if(x = 2, 1, y + 1)", 3),
        ("n < 2", None),
        ("n is null", True),
        ("n + 1", None),
        ("n <=> null", True),
        ("(x = 1) xor (y = 1)", True),
        ("x = 1 xor y = 2 xor z = 3", True),
        ("case when x = 1 xor y = 1 then 'one' else 'none' end", "one"),
        ("cast(x = 1 xor y = 2 as char)", "false"),
        ("xor(x = 1, y = 2)", False),
        ("'a xor b'", "a xor b"),
        ("if((x = 1 xor (y = 2 xor z = 9)), 1, 2)", 2),
        ("y / case when x = 1 then 2 else 0 end", 1.0),
        ("y / 1e-1", 20.0),
        ("y / +x", 2.0),
        ("y / -(x)", -2.0),
        ("z / array(3, 4)[0]", 1.0),
        ("y / (x - 1)", None),
        ("1 / (x - x) + 1", None),
        ("z /* it's / not */ / x", 3.0),
        ("y / cast(x as char)", 2.0),
        ("x = 1 && !(y = 1) || z = 9", True),
        ("(x = 1) is true", True),
        ("(n = 1) is not true", True),
        ("'t%1' like 't%1'", True),
        ("cast('12' as signed)", 12),
        ("cast('junk' as signed)", None),
        ("cast(x as char)", "1"),
        ("[two words]", "a b"),
        ("'[x] && y as char)'", "[x] && y as char)"),
        ("date_add(ts, interval 1 day)", dt.datetime(2024, 2, 8, 10, 30)),
        ("date_sub('2019-01-03', interval y day)", dt.datetime(2019, 1, 1)),
        ("ts + interval 1 quarter", dt.datetime(2024, 5, 7, 10, 30)),
        ("date_add(date_add(ts, interval 1 day), interval x hour)", dt.datetime(2024, 2, 8, 11, 30)),
        ("DAY(ts)", dt.date(2024, 2, 7)),
        ("WEEK(ts)", dt.date(2024, 2, 4)),
        ("MONTH(ts)", dt.date(2024, 2, 1)),
        ("YEAR(ts)", 2024),
        ("FISCAL_YEAR(ts, '07-01')", 2024),
        ("FISCAL_YEAR(ts)", 2024),
        ("DAY_OF_YEAR(ts)", 38),
        ("DAY_OF_FISCAL_YEAR(ts, '02-01')", 6),
        ("LOCATE('b', `two words`)", 3),
        ("regexp_like('Hello', 'hELL')", True),
        ("fulltext_boolean('The cat sat', '+cat -dog')", True),
        ("fulltext_boolean('The cat sat', 'dog cow')", False),
        ("fulltext_boolean('The cat sat', 'dog cat')", True),
        ("nullif(x, 1)", None),
    ],
)
def test_expression(one, text_, expected):
    got = value(one, text_)
    assert (float(got) if isinstance(expected, float) else got) == expected


def test_unquoted_words_only():
    assert spark_text("month_total + daily") == "month_total + daily"
    assert spark_text("t.month + x") == "t.month + x"
    assert spark_text("`month`(x)") == "`month`(x)"


DATES = [
    ("1924", "1924-01-01"),
    ("2024", "2024-01-01"),
    ("02/24", "2024-02-01"),
    ("02/2024", "2024-02-01"),
    ("02/01/2024", "2024-02-01"),
    ("2024-02-01", "2024-02-01"),
    ("2024-02", "2024-02-01"),
    ("2024-2", "2024-02-01"),
    ("5/1/1970", "1970-05-01"),
    ("2/1964", "1964-02-01"),
    ("2/1/69", "1969-02-01"),
    ("junk", None),
    ("", None),
    (None, None),
    ("13/45/2024", None),
]


def test_clean_date(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, d string")
    got = {r.i: r.o for r in dates.clean_date(df, "d", "o").collect()}
    for i, (given, expected) in enumerate(DATES):
        assert got[i] == (f"{expected}T00:00:00.000Z" if expected else None), given


def test_every_day_of_two_years(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2024-12-31')) as d")
    got = days.select(
        "d", dates.week("d").alias("w"), dates.month("d").alias("m"), dates.fiscal_year("d", "10-15").alias("fy"),
        dates.day_of_fiscal_year("d", "07-01").alias("fd"), dates.quarter_label("d").alias("q"),
    ).collect()
    assert len(got) == 731
    for r in got:
        assert r.w == r.d - dt.timedelta(days=(r.d.weekday() + 1) % 7)
        assert r.m == r.d.replace(day=1)
        assert r.fy == r.d.year + (1 if (r.d.month, r.d.day) >= (10, 15) else 0)
        opened = dt.date(r.d.year if r.d.month >= 7 else r.d.year - 1, 7, 1)
        assert r.fd == (r.d - opened).days
        assert r.q == f"{r.d.year}-Q{(r.d.month + 2) // 3}"


def test_relative_bounds(spark):
    at = F.lit("2024-03-31 12:34:56").cast("timestamp")

    def at_bound(text_):
        return spark.range(1).select(dates.relative_bound(text_, at)).first()[0]

    assert at_bound("-1M") == dt.datetime(2024, 2, 29, 12, 34, 56)
    assert at_bound("-3M.start.month") == dt.datetime(2023, 12, 1)
    assert at_bound("+2s") == dt.datetime(2024, 3, 31, 12, 34, 58)
    assert at_bound("-1d.end.day") == dt.datetime(2024, 3, 30, 23, 59, 59, 999000)
    assert at_bound("-1w.start.week") == dt.datetime(2024, 3, 24)
    assert at_bound("-1y.start.year") == dt.datetime(2023, 1, 1)
    assert at_bound("-2d.start") == dt.datetime(2024, 3, 29)
    assert at_bound("86400000") == dt.datetime(1970, 1, 2)
    assert at_bound("2024-05-06T07:08:09Z") == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert dates.relative_bound(None) is None and dates.relative_bound("none") is None
    with pytest.raises(ValueError):
        dates.relative_bound("-1d.middle.day")


def test_phone_email_names(spark):
    df = spark.createDataFrame(
        [("(555) 555-1234",), ("15555551234",), ("+44 20 7946 0958",), ("12",), (None,)], "p string"
    )
    assert [r[0] for r in df.select(text.normalize_phone("p")).collect()] == [
        "+15555551234", "+15555551234", "+442079460958", None, None,
    ]
    mail = spark.createDataFrame([("A@B@C.org",), ("none",), (None,)], "e string")
    got = [tuple(r) for r in mail.select(text.email_domain("e"), text.email_domain_first("e")).collect()]
    assert got == [("c.org", "b@c.org"), ("none", "none"), ("", "")]
    messy = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a.B` int, `x` int")
    assert text.clean_columns(messy).columns == ["a_b", "x"]
    assert text.clean_columns(messy).first()[0] == 1


def test_arithmetic_outside_of_expressions_stays_strict(spark, one):
    tool_arithmetic(lambda: one.select(expression("x / 0")))().collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one.select(F.col("x") / F.lit(0)).collect()
