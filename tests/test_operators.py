"""Filters, sides, ranks and grouping on literal rows."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealspan.operators import filters, grouping, ranking, sides
from dealspan.operators.filters import DealFilter
from dealspan.plans.brokers import top_share

DEAL = (
    "listing_firm string, buyer_firm string, listing_agent string, buyer_agent string, "
    "sold_price decimal(18,4), sold_date date"
)


def deals(spark, *rows):
    full = [
        (lf, bf, None, None, Decimal(price), date(2024, 1, 1)) for lf, bf, price in rows
    ]
    return spark.createDataFrame(full, DEAL)


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_both_sides_and_any_side(spark):
    found = deals(spark, ("x", "y", 1), ("x", "z", 1), ("y", "z", 1), (None, None, 1))
    counts = sides.side_counts(sides.deal_sides(found), "firm")
    any_side = counts.withColumn("n", sides.any_side_total())
    both = any_side.filter(sides.on_both_sides())
    assert as_map(any_side, "firm", "n") == {"x": 2, "y": 2, "z": 2}
    assert as_map(both, "firm", "n") == {"y": 2}
    nulls = as_map(counts.withColumn("n", sides.both_sides_total()), "firm", "n")
    assert nulls == {"x": None, "y": 2, "z": None}


def test_half_credit(spark):
    found = deals(spark, ("a", "a", 100), ("a", "b", 50), ("b", "c", 10), ("c", None, 7), (None, "c", 5))
    two = sides.deal_sides(sides.with_dual(found), "sold_price", "is_dual").dropna(subset=["firm"])
    sums = two.groupBy("firm").agg(sides.half_credit(F.col("sold_price")).alias("s"))
    assert as_map(sums, "firm", "s") == {"a": 100, "b": 60, "c": 22}


def test_dense_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 5), ("d", 1)], "k string, n long")
    assert as_map(ranking.dense_rank_counts(df, "n"), "k", "ranking") == {"a": 1, "b": 2, "c": 1, "d": 3}


def test_top_and_pinned_is_top_keys_with_rows(spark):
    rows = [("a", 5), ("c", 4), ("b", 4), ("d", 1), (None, 3)]
    df = spark.createDataFrame(rows, "k string, n int")
    for n in (1, 2, 3):
        for pin in (None, "a", "b", "c", "d", "missing"):
            kept = {r.k for r in ranking.top_and_pinned(df, "n", "k", n, pin).collect()}
            first = sorted(rows, key=lambda r: (-r[1], r[0] or ""))[:n]
            assert kept == {k for k, _ in first} | {k for k, _ in rows if pin and k == pin}


def test_top_share_reads_shares_once(spark):
    shares = spark.range(40).selectExpr(
        "concat('f', id % 5) AS firm", "make_date(2024, int(id div 5) + 1, 1) AS month",
        "id AS deals", "100 AS total_deals", "double(id) AS share_pct",
    )
    found = top_share(shares, 2, "f0")
    assert {r.firm for r in found.collect()} == {"f4", "f3", "f0"}
    assert found.count() == 24
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_top_keys_with_pin(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "k string, n long")
    keys = lambda d: sorted(r.k for r in d.collect())
    assert keys(ranking.top_keys(df, "n", "k", 2)) == ["a", "c"]
    assert keys(ranking.top_keys(df, "n", "k", 2, "d")) == ["a", "c", "d"]
    assert keys(ranking.top_keys(df, "n", "k", 2, "c")) == ["a", "c"]
    assert [r.k for r in ranking.bottom_n(df, "n", "k", n=2).collect()] == ["d", "a"]


def test_first_value_skips_nulls(spark):
    rows = [("k", None, 1), ("k", "late", 3), ("k", "early", 2), ("m", None, 1), (None, "x", 0)]
    df = spark.createDataFrame(rows, "k string, v string, t int")
    assert as_map(ranking.first_value_per_key(df, "k", "v", "t"), "k", "v") == {"k": "early"}


def test_packed_order_is_that_of_the_columns(spark):
    days = [None, date(1, 1, 1), date(1969, 12, 31), date(1970, 1, 1), date(9999, 12, 31)]
    ids = [None, "0", "00", "1", "10", "9", "a", "a" * 12, "a" * 11 + "b", "é", "\U0001f600"]
    rows = [(f, d, i) for f in (False, True) for d in days for i in ids]
    df = spark.createDataFrame(rows, "f boolean, d date, i string")
    packed = df.select("f", "d", "i", ranking.day_and_id("d", "i", F.col("f")).alias("k")).collect()
    by_key = [r[:3] for r in sorted(packed, key=lambda r: r.k)]
    order = lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode())
    assert [order(r) for r in by_key] == sorted(order(r) for r in rows)
    assert len({r.k for r in packed}) == len(rows)


def test_most_frequent_ties_and_nulls(spark):
    rows = [("k", "b"), ("k", "a"), ("k", None), ("k", None), ("m", "z"), ("m", "z"), ("m", "a"), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    assert as_map(ranking.most_frequent(df, "k", "v", "w"), "k", "w") == {"k": "a", "m": "z"}


def test_null_firm_differs(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b"), (None, None)], "x string, y string")
    got = [r[0] for r in df.select(filters.differs("x", F.col("y"))).collect()]
    assert got == [False, True, False]


def test_null_keys_drop(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert as_map(grouping.count_by(df, "k"), "k", "deals") == {"a": 2}


def test_distinct_agents(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "agent string")
    assert df.agg(F.count_distinct("agent")).first()[0] == 1


def test_complete_months(spark):
    df = spark.createDataFrame([("a",), ("b",)], "firm string")
    months = [date(2024, 2, 1), date(2024, 3, 1)]
    assert grouping.complete_months(df, months).count() == 4
    assert grouping.complete_months(df, []).count() == 0


def test_zero_filled_bins(spark):
    rows = [("a", 5), ("a", 1000), ("b", None), (None, 5)]
    df = spark.createDataFrame(rows, "k string, v int")
    found = grouping.zero_filled_bins(df, "k", "v", (0, 10, 20), ("low", "high"), "bin").collect()
    got = sorted((r.k, r.bin_no, r.bin, r.deals) for r in found)
    assert got == [("a", 1, "low", 1), ("a", 2, "high", 0), ("b", 1, "low", 0), ("b", 2, "high", 0)]


def test_pivot_fills_zero_and_keeps_listed_columns(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 2), ("b", 2, 1)], "k string, m int, n long")
    rows = grouping.pivot_sum(df, "k", "m", [1, 2, 3], ["one", "two", "three"], "n").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", 7, 0, 0), ("b", 0, 1, 0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (None,)], "x int")
    assert as_map(grouping.histogram(df, "x", 2), "x_bin", "deals") == {1: 1, 2: 2}


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert as_map(grouping.with_share(df, "n"), "k", "share_pct") == {"a": 25.0, "b": 75.0}
    assert grouping.with_share(df.limit(0), "n").collect() == []


def test_lookup_default(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "agent string")
    firms = spark.createDataFrame([("a", "x")], "agent string, firm string")
    found = grouping.lookup(keys, firms, "agent", "firm", "Unknown Firm")
    assert as_map(found, "agent", "firm") == {"a": "x", "b": "Unknown Firm"}


def test_options(spark):
    df = spark.createDataFrame([("b", "c"), ("a", None), (None, "a")], "x string, y string")
    assert [r.x for r in filters.options(df, "x").collect()] == ["a", "b"]
    assert [r.v for r in filters.options_union(df, "x", "y", "v").collect()] == ["a", "b", "c"]
    places = spark.createDataFrame([("P", "one"), ("Q", "two"), (None, "three")], "area_city string, community string")
    assert [r.community for r in filters.communities_of(places, ["P"]).collect()] == ["one"]
    assert [r.community for r in filters.communities_of(places).collect()] == ["one", "two"]


FILTER_ROWS = [
    ("a", date(2024, 1, 1), "f", "g", 100, 5),
    ("b", date(2024, 1, 31), "f", "f", 200, None),
    ("c", date(2024, 2, 1), None, "g", 300, 50),
    ("d", None, "h", None, None, 500),
]


@pytest.mark.parametrize(
    ("flt", "want"),
    [
        (DealFilter(), "abcd"),
        (DealFilter(start=date(2024, 1, 1), end=date(2024, 1, 31)), "ab"),
        (DealFilter(firms=("g",)), "ac"),
        (DealFilter(listing_firms=("f",)), "ab"),
        (DealFilter(price=(100, 200)), "ab"),
        (DealFilter(price=(200, None)), "bc"),
        (DealFilter(days_on_market=(0, 1000)), "acd"),
        (DealFilter(transaction=filters.LISTING), "abd"),
        (DealFilter(transaction=filters.BUYER), "abc"),
        (DealFilter(transaction=filters.DUAL), "b"),
        (DealFilter(month=2, years=(2024,)), "c"),
        (DealFilter(firms=("g",), price=(0, 150)), "a"),
    ],
)
def test_deal_filter(spark, flt, want):
    df = spark.createDataFrame(
        FILTER_ROWS,
        "id string, sold_date date, listing_firm string, buyer_firm string, sold_price int, days_on_market int",
    )
    assert "".join(sorted(r.id for r in flt.apply(df).collect())) == want
