"""Choices offered by the filters: option lists and numeric bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Option list name -> the deal columns that feed it.
OPTION_LISTS = {
    "city": ("area_city",),
    "community": ("community",),
    "property_class": ("property_class",),
    "building_type": ("building_type",),
    "year_built": ("year_built",),
    "firm": ("listing_firm", "buyer_firm"),
    "listing_firm": ("listing_firm",),
    "agent": ("listing_agent", "buyer_agent"),
}

BOUND_COLUMNS = ("sold_date", "sold_price", "days_on_market", "total_baths", "total_bedrooms")


# Cascading list name -> the column it depends on and the column it lists.
CASCADES = {"community_of_city": ("area_city", "community")}


def option_lists(deals: DataFrame) -> DataFrame:
    """Every option list in one scan of the deals: ``option``, ``parent``, ``value`` and ``position`` from 1.

    A cascading list has a list for each ``parent``, as the communities of a city; the others have a null parent. The
    distinct options are reduced in each task first; only they are sorted.
    """
    def pair(name: str, parent: Column, value: str) -> Column:
        return F.struct(F.lit(name).alias("option"), parent.cast("string").alias("parent"), F.col(value).cast("string").alias("value"))

    rows = [pair(name, F.lit(None), c) for name, columns in OPTION_LISTS.items() for c in columns]
    rows += [pair(name, F.col(a), b) for name, (a, b) in CASCADES.items()]
    known = F.col("value").isNotNull() & (F.col("parent").isNotNull() | ~F.col("option").isin(*CASCADES))
    found = deals.select(F.inline(F.array(*rows))).filter(known).distinct()
    place = F.row_number().over(Window.partitionBy("option", "parent").orderBy("value"))
    return found.withColumn("position", place)


def bounds(deals: DataFrame) -> DataFrame:
    """One row: smallest and largest value of each slider column."""
    found = []
    for c in BOUND_COLUMNS:
        found += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return deals.agg(*found)
