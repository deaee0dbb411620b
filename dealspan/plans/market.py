"""Market reports: key figures, price and style trends, heatmap, communities, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.functions.numbers import mean, ratio, total
from dealspan.functions.text import currency_text, days_text
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import histogram_2d, with_month
from dealspan.operators.ranking import top_n

DETAIL_COLUMNS = (
    "listing_id",
    "sold_date",
    "listing_agent",
    "buyer_agent",
    "sold_price",
    "community",
    "days_on_market",
    "property_class",
)


def key_figures(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """One row: sales, volume and the means of days on market, price and price per area."""
    per_area = ratio(F.col("sold_price"), F.col("total_flr_area_sf"))
    return flt.apply(deals).agg(
        F.count(F.lit(1)).alias("total_listings_sold"),
        total(F.col("sold_price")).alias("total_sales_volume"),
        mean(F.col("days_on_market")).alias("avg_dom"),
        mean(F.col("sold_price")).alias("avg_sold_price"),
        mean(per_area).alias("avg_price_per_sqft"),
    )


def price_trend(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Mean list and sold price per month."""
    found = with_month(flt.apply(deals)).dropna(subset=["month"])
    return found.groupBy("month").agg(
        mean(F.col("list_price")).alias("avg_list_price"),
        mean(F.col("sold_price")).alias("avg_sold_price"),
    )


def style_trend(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Sales per month and style: volume, count and mean."""
    found = with_month(flt.apply(deals)).dropna(subset=["month", "style"])
    return found.groupBy("month", "style").agg(
        total(F.col("sold_price")).alias("total_gross_sales"),
        F.count("sold_price").alias("total_sales"),
        mean(F.col("sold_price")).alias("avg_sales_price"),
    )


def style_totals(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Monthly totals over styles; the mean price is the mean of the style means."""
    return (
        style_trend(deals, flt)
        .groupBy("month")
        .agg(
            F.sum("total_gross_sales").alias("total_gross_sales"),
            F.sum("total_sales").alias("total_sales"),
            F.avg("avg_sales_price").alias("avg_sales_price"),
        )
    )


def dom_price_heatmap(deals: DataFrame, flt: DealFilter, nx: int = 50, ny: int = 50) -> DataFrame:
    """Deals per cell of days on market by sold price."""
    return histogram_2d(flt.apply(deals), "days_on_market", "sold_price", nx, ny)


def community_metrics(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Per community: sales, volume, means and the firm with most listings.

    One pass: sums and counts per community and firm, then per community. The second step
    reads one row per pair, and picks the winner with a mergeable ``min`` over a struct.
    """
    price, dom = F.col("sold_price"), F.col("days_on_market")
    pairs = (
        flt.apply(deals)
        .dropna(subset=["community"])
        .groupBy("community", "listing_firm")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(price).alias("_sales"),
            F.sum(price).alias("_volume"),
            F.count(dom).alias("_doms"),
            F.sum(dom).alias("_dom"),
        )
    )
    candidate = F.when(
        F.col("listing_firm").isNotNull(), F.struct((-F.col("_rows")).alias("n"), "listing_firm")
    )
    return pairs.groupBy("community").agg(
        F.sum("_sales").alias("number_of_sales"),
        ratio(F.sum("_volume"), F.sum("_sales")).alias("average_price"),
        total(F.col("_volume")).cast("decimal(28,4)").alias("total_volume"),
        ratio(F.sum("_dom"), F.sum("_doms")).alias("average_dom"),
        F.min(candidate)["listing_firm"].alias("top_selling_firm"),
    )


def community_table(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """:func:`community_metrics` with display text, most sales first."""
    return (
        community_metrics(deals, flt)
        .withColumns(
            {
                "average_price_text": currency_text(F.col("average_price")),
                "total_volume_text": currency_text(F.col("total_volume")),
                "average_dom_text": days_text(F.col("average_dom")),
            }
        )
        .orderBy(F.desc("number_of_sales"), "community")
    )


def busiest_communities(deals: DataFrame, flt: DealFilter, n: int = 20) -> DataFrame:
    """The ``n`` communities with most sales, ordered by mean days on market."""
    top = top_n(community_metrics(deals, flt), "number_of_sales", "community", n=n)
    return top.orderBy("average_dom", "community")


def transactions(deals: DataFrame, flt: DealFilter, all_columns: bool = False) -> DataFrame:
    """Filtered deals, newest first; a range sort, so no task holds them all."""
    found = flt.apply(deals)
    if all_columns:
        return found
    return found.select(*DETAIL_COLUMNS).orderBy(F.desc("sold_date"), "listing_id")
