"""One month across years: sales, prices, preferences and community breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.functions.bins import (
    AGE_LABELS,
    AREA_EDGES,
    AREA_LABELS,
    DOM_EDGES,
    DOM_LABELS,
    age_category,
    age_no,
)
from dealspan.functions.numbers import mean
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import (
    binned_counts,
    count_by,
    histogram,
    with_share,
    zero_filled_bins,
)
from dealspan.operators.ranking import keep_keys, top_n


def month_filter(
    years: Sequence[int], month: int = 1, cities: Sequence[str] = (), communities: Sequence[str] = ()
) -> DealFilter:
    """Deals of one month in the given years that have a city and a community."""
    return DealFilter(
        month=month,
        years=tuple(years),
        cities=tuple(cities),
        communities=tuple(communities),
        located=True,
    )


def _found(deals: DataFrame, flt: DealFilter) -> DataFrame:
    return flt.apply(deals).withColumn("year", F.year("sold_date"))


def sales_by_year(deals: DataFrame, flt: DealFilter) -> DataFrame:
    return count_by(_found(deals, flt), "year", name="properties_sold")


def prices_by_year(deals: DataFrame, flt: DealFilter) -> DataFrame:
    return (
        _found(deals, flt)
        .groupBy("year")
        .agg(
            mean(F.col("sold_price")).alias("avg_sold_price"),
            mean(F.col("list_price")).alias("avg_list_price"),
        )
    )


def frequency_by_year(deals: DataFrame, flt: DealFilter, column: str) -> DataFrame:
    """Deals per value of a column and year."""
    return count_by(_found(deals, flt), column, "year")


def area_histogram(deals: DataFrame, flt: DealFilter, n: int = 20) -> DataFrame:
    """Floor-area histogram per year on bins shared by all years."""
    return histogram(_found(deals, flt), "total_flr_area_sf", n, "year")


def property_class_share(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Deals and percentage per property class over all years."""
    return with_share(count_by(flt.apply(deals), "property_class"), "deals")


def age_by_year(deals: DataFrame, flt: DealFilter) -> DataFrame:
    age = age_category(F.col("sold_date"), F.col("year_built"))
    return count_by(_found(deals, flt).withColumn("age_category", age), "year", "age_category")


def community_age(deals: DataFrame, flt: DealFilter, n: int = 10) -> DataFrame:
    """Deals per age category for the communities with most deals."""
    number = age_no(F.col("sold_date"), F.col("year_built"))
    found = binned_counts(flt.apply(deals), "community", number, AGE_LABELS, "age_category", top=n)
    return found.filter(F.col("deals") > 0).drop("bin_no")


def community_frequency(deals: DataFrame, flt: DealFilter, column: str, n: int = 10) -> DataFrame:
    """Deals per value of a column for the communities with most deals.

    Both branches read the same grouped counts, whose shuffle Spark then writes once. Deals
    without a value count for the choice of communities but give no row.
    """
    counts = (
        flt.apply(deals)
        .groupBy("community", column)
        .agg(F.count(F.lit(1)).alias("deals"), F.count(column).alias("_known"))
    )
    sums = counts.groupBy("community").agg(
        F.sum("deals").alias("_deals"), F.sum("_known").alias("_some")
    )
    top = top_n(sums, "_deals", "community", n=n).filter(F.col("_some") > 0)
    return keep_keys(counts.filter(F.col("_known") > 0), top, "community").drop("_known")


def community_area_ranges(deals: DataFrame, flt: DealFilter, n: int = 10) -> DataFrame:
    """Deals per floor-area range, empty ranges included."""
    return zero_filled_bins(
        flt.apply(deals), "community", "total_flr_area_sf", AREA_EDGES, AREA_LABELS, "size_range", n
    )


def community_dom_ranges(deals: DataFrame, flt: DealFilter, n: int = 10) -> DataFrame:
    """Deals per days-on-market range, empty ranges included."""
    return zero_filled_bins(
        flt.apply(deals), "community", "days_on_market", DOM_EDGES, DOM_LABELS, "dom_range", n
    )
