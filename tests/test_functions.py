import re
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import numbers, text
from fleetlens.operators.backup import clean_template, date_tokens

BIG = 2**62


def test_ratio_matches_exact_arithmetic(spark):
    cases = [
        (1, 8, 2), (1, 3, 3), (5, 1000, 2), (-5, 1000, 2), (5, -1000, 2), (-7, -2, 0), (0, 7, 2),
        (BIG, BIG, 2), (BIG // 100, BIG - 1, 6), (BIG - 1, 3 * 10**15, 3), (999, 1000, 2), (7, 0, 2),
    ]
    for num, den, scale in cases:
        values = spark.createDataFrame([(num, den)], "n bigint, d bigint")
        got, literal = values.select(
            numbers.ratio("n", "d", 25, scale), numbers.ratio("n", den, 25, scale)
        ).first()
        assert literal == got, (num, den, scale)
        if den == 0:
            assert got is None
        else:
            want = (Decimal(num) / Decimal(den)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
            assert got == want, (num, den, scale)


def test_ratio_zero_divisor_default(spark):
    got = spark.range(1).select(numbers.ratio("5", "0", 12, 3, on_zero=0)).first()[0]
    assert got == Decimal("0.000")


def test_int_div_truncates(spark):
    row = spark.range(1).select(
        numbers.int_div(F.lit(-7), F.lit(2)), numbers.int_div(F.lit(7), F.lit(0))
    ).first()
    assert tuple(row) == (-3, None)


def test_quote_and_parse_names(rows):
    df = rows("n string", ("a]b",), ("db.dbo.t",), ("[d.b].[x]].y].t.ix",), ("db..t",), ("a.b.c.d.e",))
    got = df.select(
        text.quote_name("n"), *[text.parse_name("n", i) for i in (1, 2, 3, 4)]
    ).collect()
    assert [tuple(r) for r in got] == [
        ("[a]]b]", "a]b", None, None, None),
        ("[db.dbo.t]", "t", "dbo", "db", None),
        ("[[d.b]].[x]]]].y]].t.ix]", "ix", "t", "x].y", "d.b"),
        ("[db..t]", "t", None, "db", None),
        ("[a.b.c.d.e]", None, None, None, None),
    ]
    assert df.select(text.quote_name(F.lit("it's"), "'")).first()[0] == "'it''s'"


def test_like_regex(rows):
    cases = [
        ("AB_c", "ab_C", True), ("abXc", "ab_c", False), ("anything", "%", True), ("a.c", "a.c", True),
        ("abc", "a.c", False), ("x1", "x[0-9]", True), ("xa", "x[^0-9]", True), ("x5", "x[^0-9]", False),
        ("50%", "50[%]", True), ("500", "50[%]", False), ("a[b", "a[b", True), ("line\nbreak", "l%k", True),
        ("abc", "ab", False), ("a+b", "a+b", True), ("ÉCOLE", "école", True),
    ]
    df = rows("v string, p string, want boolean", *cases)
    wrong = df.filter(F.rlike("v", text.like_regex("p")) != F.col("want")).collect()
    assert wrong == []


def test_durations(rows):
    df = rows("s bigint", (0,), (59,), (3661,), (86399,), (86400,), (90061,), (None,))
    assert [r[0] for r in df.select(text.duration_text("s")).collect()] == [
        "00:00:00", "00:00:59", "01:01:01", "23:59:59", "1.00:00:00", "1.01:01:01", None,
    ]
    assert df.select(text.hour_min_sec("s")).collect()[5][0] == "25 hour(s), 1min, 1 sec"


def test_statement_text(rows):
    df = rows("t string, a int, b int", ("SELECT 1; SELECT 2", 0, 14), ("SELECT 1; SELECT 2", 20, -1),
              ("SELECT 1; SELECT 2", 0, -1))
    assert [r[0] for r in df.select(text.statement_text("t", "a", "b")).collect()] == [
        "SELECT 1", "SELECT 2", "SELECT 1; SELECT 2",
    ]


def test_parent_pattern(rows):
    df = rows("p string", ("C:\\log\\system_health_0_1.xel",), ("plain.xel",))
    assert [r[0] for r in df.select(text.parent_pattern("p", "system_health*.xel")).collect()] == [
        "C:\\log\\system_health*.xel", "system_health*.xel",
    ]


def _tidy_slowly(value: str, directory: bool) -> str:
    """The tidying rules applied one by one until nothing changes."""
    pairs = ["__ _", "-- -", "// /", "/$ /", "$/ /", "/_ /", "_/ /", "/- /", "-/ /", "_$ _", "$_ _", "-$ -", "$- -"]
    if not directory:
        pairs = [p for p in pairs if "/" not in p] + ["_. .", "-. ."]
    while True:
        before = value
        for pair in pairs:
            value = value.replace(*pair.split(" "))
        if not directory:
            value = re.sub("(?i)of\\.", ".", value)
        for end in "_-$/" if directory else "_-$":
            value = value.removeprefix(end)
            value = value.removesuffix(end)
        if value == before:
            return value


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="_-$.aofO/", max_size=12), min_size=20, max_size=40), st.booleans())
def test_clean_template_reaches_the_fixpoint(spark, values, directory):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(clean_template(F.col("t"), directory)).collect()]
    assert got == [_tidy_slowly(v, directory) for v in values]


def test_week_starts_on_sunday(spark):
    days = {"2001-01-01": "01", "2001-01-06": "01", "2001-01-07": "02", "2023-01-01": "01",
            "2023-12-31": "53", "2000-12-31": "54"}
    for day, week in days.items():
        asof = F.lit(day).cast("timestamp_ntz")
        assert spark.range(1).select(date_tokens(asof)["Week"]).first()[0] == week, day
