"""One firm against the market, and the agents in its deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealspan.functions.dates import MONTH_NAMES
from dealspan.functions.numbers import mean, one_place, percent, ratio, total, whole
from dealspan.operators.filters import DealFilter, differs, either_is, require_dates
from dealspan.operators.grouping import count_by, with_month
from dealspan.operators.ranking import bottom_n, top_n
from dealspan.operators.sides import deal_sides, with_dual


def focus_deals(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """Filtered deals with the firm on either side."""
    return flt.apply(deals).filter(_involves(focus_firm))


def _involves(focus_firm: str) -> Column:
    return F.coalesce(either_is("listing_firm", "buyer_firm", focus_firm), F.lit(False))


def key_figures(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """One row: focus deals and volume, means of focus and market and their differences."""
    mine = _involves(focus_firm)
    means = (
        flt.apply(deals)
        .withColumn("_mine", mine)
        .agg(
            F.count_if("_mine").alias("focus_deals"),
            total(F.when(F.col("_mine"), F.col("sold_price"))).alias("focus_volume"),
            mean(F.when(F.col("_mine"), F.col("days_on_market"))).alias("focus_dom"),
            mean(F.col("days_on_market")).alias("market_dom"),
            mean(F.when(F.col("_mine"), F.col("sold_list_ratio"))).alias("focus_ratio"),
            mean(F.col("sold_list_ratio")).alias("market_ratio"),
        )
    )
    return means.withColumns(
        {
            "dom_delta": F.col("market_dom") - F.col("focus_dom"),
            "ratio_delta": F.col("focus_ratio") - F.col("market_ratio"),
        }
    )


def key_figures_display(figures: DataFrame) -> DataFrame:
    """Display form: means cut to whole days, ratios at one place."""
    dom = {c: whole(F.col(c)) for c in ("focus_dom", "market_dom")}
    ratios = {c: one_place(F.col(c)) for c in ("focus_ratio", "market_ratio")}
    shown = figures.withColumns({**dom, **ratios})
    return shown.withColumns(
        {
            "dom_delta": F.col("market_dom") - F.col("focus_dom"),
            "ratio_delta": one_place(F.col("focus_ratio") - F.col("market_ratio")),
        }
    )


def share_of_deals(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """Deals of the focus firm and of its competitors, with percentages."""
    counts = flt.apply(deals).agg(
        F.count_if(_involves(focus_firm)).alias("_mine"), F.count(F.lit(1)).alias("_all")
    )
    rows = F.array(
        F.struct(F.lit("Focus").alias("party"), F.col("_mine").alias("deals")),
        F.struct(F.lit("Competitors").alias("party"), (F.col("_all") - F.col("_mine")).alias("deals")),
    )
    listed = counts.select("_all", F.inline(rows))
    return listed.select("party", "deals", (ratio(F.col("deals"), F.col("_all")) * 100).alias("share_pct"))


def by_property_class(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    return count_by(focus_deals(deals, flt, focus_firm), "property_class")


def top_communities_by_volume(
    deals: DataFrame, flt: DealFilter, focus_firm: str, n: int = 10
) -> DataFrame:
    sums = (
        focus_deals(deals, flt, focus_firm)
        .dropna(subset=["community"])
        .groupBy("community")
        .agg(total(F.col("sold_price")).alias("volume"))
    )
    return top_n(sums, "volume", "community", n=n)


def top_communities_by_count(
    deals: DataFrame, flt: DealFilter, focus_firm: str, n: int = 10
) -> DataFrame:
    return top_n(count_by(focus_deals(deals, flt, focus_firm), "community"), "deals", "community", n=n)


def monthly_trend(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """Focus deals and mean days on market per month."""
    found = with_month(focus_deals(deals, flt, focus_firm)).dropna(subset=["month"])
    return found.groupBy("month").agg(
        F.count("listing_id").alias("deals"), mean(F.col("days_on_market")).alias("avg_dom")
    )


def seasonal_dom(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """Mean days on market, month names down in calendar order, years across.

    Years come from the filter dates, so no extra job looks for them. Months without deals
    keep their row.
    """
    require_dates(flt, "the year columns")
    years = list(range(flt.start.year, flt.end.year + 1))
    found = focus_deals(deals, flt, focus_firm).select(
        F.month("sold_date").alias("month_no"), F.year("sold_date").alias("_year"), "days_on_market"
    )
    wide = found.groupBy("month_no").pivot("_year", years).agg(mean(F.col("days_on_market")))
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("month_no"), F.lit(m).alias("month"))
            for i, m in enumerate(MONTH_NAMES, 1)
        ]
    )
    calendar = deals.sparkSession.range(1).select(F.inline(listed))
    columns = [F.col(f"`{y}`").alias(f"y{y}") for y in years]
    return (
        calendar.join(wide, "month_no", "left")
        .select("month_no", "month", *columns)
        .orderBy("month_no")
    )


def role_shares(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """Focus deals on the listing side and on the buyer side, with percentages."""
    counts = focus_deals(deals, flt, focus_firm).agg(
        F.count_if(F.col("listing_firm") == focus_firm).alias("_l"),
        F.count_if(F.col("buyer_firm") == focus_firm).alias("_b"),
    )
    rows = F.array(
        F.struct(F.lit("Listing Firm").alias("role"), F.col("_l").alias("deals")),
        F.struct(F.lit("Buyer Firm").alias("role"), F.col("_b").alias("deals")),
    )
    listed = counts.select((F.col("_l") + F.col("_b")).alias("_all"), F.inline(rows))
    return listed.select("role", "deals", (ratio(F.col("deals"), F.col("_all")) * 100).alias("share_pct"))


def competitor_roles(deals: DataFrame, flt: DealFilter, focus_firm: str, n: int = 10) -> DataFrame:
    """Mean deals of the top listing competitors per role, with percentages.

    Buyer groups count only deals a top competitor listed. A listing firm keeps its counts per buyer firm,
    at most one for each firm, so both roles come from one pass over the deals; what follows the top list
    works on ``n`` rows. The focus firm takes at most one place, and is left out before the list.
    """
    others = F.col("listing_firm").isNotNull() & differs("listing_firm", F.lit(focus_firm))
    pairs = flt.apply(deals).filter(others).groupBy("listing_firm", "buyer_firm").agg(F.count(F.lit(1)).alias("_n"))
    firms = pairs.groupBy("listing_firm").agg(
        F.sum("_n").alias("deals"), F.collect_list(F.struct("buyer_firm", "_n")).alias("_bought")
    )
    chosen = Window.partitionBy()  # over the n rows of the top list
    top = top_n(firms, "deals", "listing_firm", n=n).select(
        F.avg("deals").over(chosen).alias("_listed"), F.collect_set("listing_firm").over(chosen).alias("_top"), "_bought"
    )
    inside = F.filter("_bought", lambda b: F.array_contains("_top", b["buyer_firm"]))
    each = top.select("_listed", F.explode_outer(inside).alias("b")).select("_listed", "b.buyer_firm", "b._n")
    buyers = each.groupBy("buyer_firm").agg(F.sum("_n").alias("_n"), F.max("_listed").alias("_listed"))
    means = buyers.agg(F.max("_listed").alias("_l"), F.avg("_n").alias("_b"))
    rows = F.array(
        F.struct(F.lit("Listing Firm").alias("role"), F.col("_l").alias("avg_deals")),
        F.struct(F.lit("Buyer Firm").alias("role"), F.col("_b").alias("avg_deals")),
    )
    both = F.coalesce(F.col("_l"), F.lit(0.0)) + F.coalesce(F.col("_b"), F.lit(0.0))
    listed = means.select(both.alias("_all"), F.inline(rows))
    return listed.select("role", "avg_deals", percent(F.col("avg_deals"), F.col("_all")).alias("share_pct"))


def agent_activity(deals: DataFrame, flt: DealFilter, focus_firm: str) -> DataFrame:
    """One row: distinct focus agents over both roles, focus deals and deals per agent.

    Each focus deal counts once: on its listing side, or on its buyer side if not dual.
    """
    mine = focus_deals(deals, flt, focus_firm)
    sides = deal_sides(with_dual(mine), "is_dual", agent=True).filter(F.col("firm") == focus_firm)
    counts = sides.agg(
        F.count_distinct("agent").alias("active_agents"),
        F.count_if(F.col("is_listing") | ~F.col("is_dual")).alias("closed_deals"),
    )
    return counts.withColumn("deals_per_agent", ratio(F.col("closed_deals"), F.col("active_agents")))


def _agent_totals(deals: DataFrame, side: str) -> DataFrame:
    return (
        deals.select(F.col(f"{side}_agent").alias("agent"), "listing_id", "sold_price")
        .dropna(subset=["agent"])
        .groupBy("agent")
        .agg(F.count("listing_id").alias("deals"), total(F.col("sold_price")).alias("revenue"))
    )


def top_agents(
    deals: DataFrame, flt: DealFilter, focus_firm: str, side: str, n: int = 10
) -> DataFrame:
    """Agents with most deals on one side of focus deals; the other firm's agents count too."""
    totals = _agent_totals(focus_deals(deals, flt, focus_firm), side)
    return top_n(totals, "deals", "agent", n=n)


def bottom_agents(
    deals: DataFrame, flt: DealFilter, focus_firm: str, side: str, n: int = 10
) -> DataFrame:
    """The focus firm's own agents with fewest deals on one side."""
    own = flt.apply(deals).filter(F.col(f"{side}_firm") == focus_firm)
    return bottom_n(_agent_totals(own, side), "deals", "agent", n=n)
