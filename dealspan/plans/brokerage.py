"""Brokerage reports on stored firm names: period totals, market share, league tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import count_by
from dealspan.operators.ranking import top_n
from dealspan.operators.sides import any_side_total, deal_sides, side_counts
from dealspan.plans.brokers import firm_month_share, is_focus, top_share


def period_totals(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """One row: deals and distinct listing firms."""
    return flt.apply(deals).agg(
        F.count(F.lit(1)).alias("total_deals"),
        F.count_distinct("listing_firm").alias("total_brokerages"),
    )


def market_share(
    deals: DataFrame, flt: DealFilter, focus_firm: str | None = None, n: int = 10,
    share_base: str = "deals",
) -> DataFrame:
    """Monthly market share of the top firms plus the pinned focus firm."""
    return top_share(firm_month_share(flt.apply(deals), share_base), n, focus_firm)


def top_brokerages(
    deals: DataFrame, flt: DealFilter, focus_firm: str | None = None, n: int = 10
) -> DataFrame:
    """Firms with most deals over both sides; a firm on one side only counts as well."""
    counts = side_counts(deal_sides(flt.apply(deals)), "firm").select(
        "firm",
        F.col("n_listing").alias("listing_deals"),
        F.col("n_buyer").alias("buyer_deals"),
        any_side_total().alias("total_deals"),
    )
    top = top_n(counts, "total_deals", "firm", n=n)
    return top.withColumn("is_focus", is_focus("firm", focus_firm))


def top_brokerages_by_side(
    deals: DataFrame, flt: DealFilter, side: str, focus_firm: str | None = None, n: int = 10
) -> DataFrame:
    """Firms with most deals on one side; an absent firm column gives an empty table."""
    name = f"{side}_firm"
    found = flt.apply(deals)
    if name not in found.columns:
        found = found.withColumn(name, F.lit(None).cast("string"))
    counts = count_by(found.select(F.col(name).alias("firm")), "firm")
    return top_n(counts, "deals", "firm", n=n).withColumn("is_focus", is_focus("firm", focus_firm))
