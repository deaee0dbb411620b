"""Cleaning and scalar functions on literal values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealspan.functions import bins, dates, numbers, text

V = "v"


def test_currency(spark, one):
    got = one(["$1,200.50", "$0", None], "string", numbers.parse_currency(F.col(V)))
    assert got == [Decimal("1200.50"), Decimal("0.00"), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(["abc"], "string", numbers.parse_currency(F.col(V)))


def test_grouped_number(spark, one):
    assert one(["1,234", "7.5", None], "string", numbers.parse_grouped(F.col(V))) == [1234.0, 7.5, None]


def test_lenient_number_keeps_the_currency_sign_as_bad_text(spark, one):
    got = one(["5", "$6", None, "x"], "string", numbers.lenient_number(F.col(V)))
    assert got == [Decimal("5.0000"), None, None, None]


def test_safe_decimal(spark, one):
    got = one(["$1,200.50", "$0", None, "abc", ""], "string", numbers.safe_decimal(F.col(V)))
    assert got == [Decimal("1200.5"), 0, 0, 0, 0]


def test_finite_or_null(spark, one):
    values = [float("nan"), float("inf"), float("-inf"), 1.5, None]
    assert one(values, "double", numbers.finite_or_null(F.col(V))) == [None, None, None, 1.5, None]


def test_nested_floats_to_decimal(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1.5, "b": float("nan")}, [2.5, float("inf")], (0.5, "x")), (2, None, None, None)],
        "id int, m map<string,double>, l array<double>, s struct<x:double,y:string>",
    )
    first, second = numbers.decimal_items(df).orderBy("id").collect()
    assert first.m == {"a": Decimal("1.5"), "b": None}
    assert first.l == [Decimal("2.5"), None]
    assert (first.s.x, first.s.y) == (Decimal("0.5"), "x")
    assert (second.m, second.l, second.s) == (None, None, None)


def test_mean_and_total_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v decimal(18,4)")
    row = df.agg(numbers.mean(F.col(V)).alias("m"), numbers.total(F.col(V)).alias("t")).first()
    assert (row.m, row.t) == (None, 0)


def test_safe_ratio(spark):
    df = spark.createDataFrame([(0, 0.0), (3, 0.0), (3, 2.0), (None, 2.0)], "a int, b double")
    got = [r[0] for r in df.select(numbers.ratio_or_zero(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, 1.5, 0.0]
    assert df.select(numbers.percent(F.col("a"), F.col("b"))).collect()[2][0] == 150.0


def test_display_rounding(spark, one):
    assert one([12.9, 3.0], "double", numbers.whole(F.col(V))) == [12, 3]
    assert one([97.36, 97.31], "double", numbers.one_place(F.col(V))) == [97.4, 97.3]


def test_strict_date(spark, one):
    got = one(["01/05/2024", "1/5/2024", None], "string", dates.strict_date(F.col(V)))
    assert got == [date(2024, 1, 5), date(2024, 1, 5), None]
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        one(["2024-01-05"], "string", dates.strict_date(F.col(V)))


def test_lenient_date(spark, one):
    values = ["01/05/2024", "1/5/2024", "2024-01-05", "13/01/2024", "N/A"]
    day = date(2024, 1, 5)
    assert one(values, "string", dates.lenient_date(F.col(V))) == [day, day, None, None, None]
    got = one(values, "string", dates.lenient_date(F.col(V), dates.KNOWN_FORMATS))
    assert got == [day, day, day, None, None]


def test_calendar(spark, one):
    days = [date(2024, 3, 31)]
    assert one(days, "date", dates.month_start(F.col(V))) == [date(2024, 3, 1)]
    assert one(days, "date", dates.month_name(F.col(V))) == ["March"]
    assert one(days, "date", dates.month_label(F.col(V))) == ["Mar-2024"]
    assert one([datetime(2024, 3, 31, 23, 59)], "timestamp_ntz", dates.day(F.col(V))) == days


def test_month_lists():
    mid = dates.months_between(date(2024, 1, 15), date(2024, 3, 15))
    assert mid == [date(2024, 2, 1), date(2024, 3, 1)]
    assert dates.months_between(date(2023, 12, 1), date(2024, 1, 1)) == [date(2023, 12, 1), date(2024, 1, 1)]
    assert dates.months_between(date(2024, 1, 2), date(2024, 1, 31)) == []
    assert dates.months_touched(date(2024, 1, 15), date(2024, 2, 1)) == [date(2024, 1, 1), date(2024, 2, 1)]


def test_title_case(spark, one):
    values = ["re/max elite", "o'brien-smith co", "2percent", None, "ÉLAN vital"]
    want = ["Re/Max Elite", "O'Brien-Smith Co", "2Percent", None, "Élan Vital"]
    assert one(values, "string", text.title_case(F.col(V))) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ 09-/'.&", max_size=12), min_size=1, max_size=20))
def test_title_case_is_pythons(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, v string")
    got = [r.r for r in df.select("i", text.title_case(F.col(V)).alias("r")).orderBy("i").collect()]
    assert got == [w.title() for w in words]


def test_names_and_missing_text(spark, one):
    values = ["  Re/Max ", None, "nan", "N/A", "", "None", "ok"]
    assert one(values, "string", text.normalize_name(F.col(V)))[:2] == ["re/max", None]
    assert one(values, "string", text.known_text(F.col(V)))[1:] == [None, None, None, None, None, "ok"]
    assert one(values, "string", text.text_or_na(F.col(V)))[1] == "N/A"


def test_display_text(spark, one):
    values = [Decimal("1234567.8950"), Decimal("-5.0000"), None]
    got = one(values, "decimal(18,4)", text.currency_text(F.col(V)))
    assert got == ["$1,234,567.90", "$-5.00", "N/A"]
    assert one([12.34, None], "double", text.days_text(F.col(V))) == ["12.3 days", "N/A"]


def test_joined_distinct(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert df.agg(text.joined_distinct(F.col(V))).first()[0] == "a, b"


def test_underscore_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert text.underscore_names(df).columns == ["a_b", "c"]


@pytest.mark.parametrize(
    ("shown", "want"),
    [("100-500", (100, 500)), ("oops", (0, None)), ("100", (0, None)), ("a-b", (0, None)), (" 1 - 2 ", (1, 2))],
)
def test_range_param(shown, want):
    assert text.range_param(shown) == want


def test_area_and_dom_ranges(spark, one):
    area = one([0.0, 499.0, 499.5, 500.0, 4999.0, 5000.0, -1.0, None], "double", bins.area_range(F.col(V)))
    assert area == ["0-499"] * 3 + ["500-999", "4500-4999", None, None, None]
    dom = one([0, 9, 10, 40, 999, 1000], "int", bins.dom_range(F.col(V)))
    assert dom == ["0-10", "0-10", "10-20", "40+", "40+", None]


def test_age_category(spark, one):
    built = [2030, 2024, 2022, 2021, 2019, 2018, None]
    got = one(built, "int", bins.age_category(F.lit(date(2024, 6, 1)), F.col(V)))
    assert got == ["1-2 years"] * 3 + ["3-5 years"] * 2 + ["5+ years", "Unknown"]


def test_equal_width(spark, one):
    low, high = F.lit(0.0), F.lit(10.0)
    got = one([0.0, 0.9, 1.0, 9.99, 10.0, None], "double", bins.equal_width(F.col(V), low, high, 10))
    assert got == [1, 1, 2, 10, 10, None]
    assert one([3.0, 3.0], "double", bins.equal_width(F.col(V), F.lit(3.0), F.lit(3.0), 5)) == [1, 1]
