"""Agent ranking and the reports of one agent."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.functions.numbers import ratio_or_zero, total
from dealspan.functions.text import joined_distinct
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import count_by, with_month
from dealspan.operators.ranking import dense_rank_counts
from dealspan.operators.sides import deal_sides


def ranking(deals: DataFrame) -> DataFrame:
    """All agents by deals on either side, dense rank, over the unfiltered table."""
    totals = count_by(deal_sides(deals, firm=False, agent=True), "agent", name="total_deals")
    return dense_rank_counts(totals, "total_deals").select("agent", "total_deals", "ranking")


def rank_of(deals: DataFrame, agent: str) -> DataFrame:
    """One agent's row of :func:`ranking`."""
    return ranking(deals).filter(F.col("agent") == agent)


def agent_deals(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    """Filtered deals with the agent on either side."""
    return replace(flt, agents=(agent,)).apply(deals)


def key_figures(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    """One row: deals, gross sales and mean price, all 0 without deals."""
    sums = agent_deals(deals, flt, agent).agg(
        F.count(F.lit(1)).alias("total_deals"), total(F.col("sold_price")).alias("gross_sales")
    )
    price = ratio_or_zero(F.col("gross_sales"), F.col("total_deals"))
    return sums.withColumn("avg_price_per_deal", price)


def firms(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    """Firms the agent worked for, one row each."""
    sides = deal_sides(agent_deals(deals, flt, agent), agent=True)
    own = sides.filter(F.col("agent") == agent).select("firm")
    return own.dropna().distinct()


def firms_text(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    """:func:`firms` as one sorted text; only distinct names of one agent reach it."""
    return firms(deals, flt, agent).agg(joined_distinct(F.col("firm")).alias("firms"))


def monthly_deals(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    return count_by(with_month(agent_deals(deals, flt, agent)), "month")


def deals_by_community(deals: DataFrame, flt: DealFilter, agent: str) -> DataFrame:
    return count_by(agent_deals(deals, flt, agent), "community", "area_city")
