"""Broker reports: firm and agent league tables, headcount, deals per agent, market share.

Firm names are compared in lower case without outer blanks, so these reports normalise them
first; filters and ``focus_firm`` follow the same rule.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealspan.functions.dates import month_label, month_start, months_between, months_touched
from dealspan.functions.numbers import mean, percent, ratio_or_zero, total
from dealspan.functions.text import currency_text, normalize_name, title_case
from dealspan.operators.filters import DealFilter, require_dates
from dealspan.operators.grouping import complete_months, count_by, pivot_sum, with_month
from dealspan.operators.ranking import day_and_id, first_value_per_key, top_and_pinned, top_n
from dealspan.operators.sides import (
    any_side_total,
    both_sides_total,
    deal_sides,
    half_credit,
    on_both_sides,
    side_counts,
    with_dual,
)

UNKNOWN_FIRM = "Unknown Firm"


def normalized(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Filtered deals with normalised firm names."""
    names = [c for c in ("listing_firm", "buyer_firm") if c in deals.columns]
    same = deals.withColumns({c: normalize_name(F.col(c)) for c in names})
    folded = replace(
        flt,
        firms=tuple(f.lower().strip() for f in flt.firms),
        listing_firms=tuple(f.lower().strip() for f in flt.listing_firms),
    )
    return folded.apply(same)


def is_focus(key: str, focus: str | None) -> Column:
    """Highlight flag of one firm."""
    return F.lit(False) if focus is None else F.col(key) == F.lit(focus)


def _folded(focus: str | None) -> str | None:
    return None if focus is None else focus.lower().strip()


def _firm_league(totals: DataFrame, focus: str | None, n: int) -> DataFrame:
    return top_n(totals, "deals", "firm", n=n).select(
        "firm",
        title_case(F.col("firm")).alias("office"),
        "deals",
        "gross_sales",
        currency_text(F.col("gross_sales")).alias("gross_sales_text"),
        is_focus("firm", _folded(focus)).alias("is_focus"),
    )


def top_firms(
    deals: DataFrame, flt: DealFilter, side: str, focus_firm: str | None = None, n: int = 10
) -> DataFrame:
    """Largest firms on one side by deals, with gross sales. ``side``: listing or buyer."""
    picked = normalized(deals, flt).select(F.col(f"{side}_firm").alias("firm"), "sold_price")
    totals = (
        picked.dropna(subset=["firm"])
        .groupBy("firm")
        .agg(F.count(F.lit(1)).alias("deals"), total(F.col("sold_price")).alias("gross_sales"))
    )
    return _firm_league(totals, focus_firm, n)


def top_combined_firms(
    deals: DataFrame, flt: DealFilter, focus_firm: str | None = None, n: int = 10
) -> DataFrame:
    """Largest firms among those on both sides: total deals and half-credit sales."""
    sides = deal_sides(with_dual(normalized(deals, flt)), "sold_price", "is_dual")
    totals = (
        sides.dropna(subset=["firm"])
        .groupBy("firm")
        .agg(
            F.count_if("is_listing").alias("n_listing"),
            F.count_if(~F.col("is_listing")).alias("n_buyer"),
            F.coalesce(half_credit(F.col("sold_price")), F.lit(0)).alias("gross_sales"),
        )
        .filter(on_both_sides())
        .withColumn("deals", any_side_total())
    )
    return _firm_league(totals, focus_firm, n)


def average_headcount(brokerage: DataFrame, flt: DealFilter) -> DataFrame:
    """Mean headcount per broker and month inside the filter's dates, as far as they are set."""
    found = brokerage if flt.start is None else brokerage.filter(F.col("date") >= F.lit(flt.start))
    found = found if flt.end is None else found.filter(F.col("date") <= F.lit(flt.end))
    return (
        found.select(
            normalize_name(F.col("broker")).alias("firm"),
            month_start(F.col("date")).alias("month"),
            "value",
        )
        .dropna(subset=["firm", "month"])
        .groupBy("firm", "month")
        .agg(mean(F.col("value")).alias("avg_agents"))
    )


def _staffed_deals(deals: DataFrame, brokerage: DataFrame, flt: DealFilter) -> DataFrame:
    """Deals and headcount per firm and month, for firm-months found in both tables.

    A firm on one side only in a month has null deals.
    """
    sides = with_month(deal_sides(normalized(deals, flt), "sold_date"))
    monthly = side_counts(sides, "firm", "month").select(
        "firm", "month", both_sides_total().alias("deals")
    )
    return monthly.join(average_headcount(brokerage, flt), ["firm", "month"])


def deals_per_agent(
    deals: DataFrame, brokerage: DataFrame, flt: DealFilter,
    focus_firm: str | None = None, n: int = 10,
) -> DataFrame:
    """Monthly deals per agent for the largest brokers and the focus firm, on a full month grid.

    A broker's months stay with its total, so both tables are read once, and the grid is unfolded for
    the chosen brokers only. Missing months, one-sided months and
    months without headcount all give 0.
    """
    require_dates(flt, "the month grid")
    staffed = _staffed_deals(deals, brokerage, flt)
    months = months_between(flt.start, flt.end)
    in_grid = F.col("month").isin(months) if months else F.lit(False)
    cells = F.collect_list(F.struct("month", F.struct("deals", "avg_agents")))
    firms = staffed.groupBy("firm").agg(
        total(F.when(in_grid, F.col("deals"))).alias("in_grid"),
        F.map_from_entries(cells).alias("cells"),
    )
    chosen = top_and_pinned(firms, "in_grid", "firm", n, _folded(focus_firm))
    grid = complete_months(chosen.select("firm", "cells"), months)
    found = grid.select("firm", "month", F.col("cells")[F.col("month")].alias("cell"))
    found = found.select("firm", "month", "cell.deals", "cell.avg_agents")
    return found.select(
        "firm",
        "month",
        F.coalesce("deals", F.lit(0)).alias("deals"),
        F.coalesce("avg_agents", F.lit(0.0)).alias("avg_agents"),
        ratio_or_zero(F.col("deals"), F.col("avg_agents")).alias("deals_per_agent"),
    )


def firm_month_share(deals: DataFrame, share_base: str = "deals") -> DataFrame:
    """Each firm's two-sided deals per month as a percentage of that month's market.

    ``share_base='deals'`` divides by the deals of the month, so a month adds up to 200 %;
    ``'sides'`` divides by the sides with a firm, so a month adds up to 100 %. Each deal counts for its firms and, in a row
    of its own, for its month, so one aggregate has both; the window spreads a month's total over its firms.
    """
    rows = [F.struct(F.lit(True).alias("is_firm"), F.col(c).alias("firm")) for c in ("listing_firm", "buyer_firm")]
    whole = F.struct(F.lit(False).alias("is_firm"), F.lit(None).cast("string").alias("firm"))
    each = deals.select("sold_date", F.inline(F.array(*rows, *([whole] if share_base == "deals" else []))))
    known = with_month(each).filter((F.col("firm").isNotNull() | ~F.col("is_firm")) & F.col("month").isNotNull())
    counts = known.groupBy("is_firm", "firm", "month").agg(F.count(F.lit(1)).alias("deals"))
    market = F.sum(F.when(F.col("is_firm") == (share_base != "deals"), F.col("deals"))).over(Window.partitionBy("month"))
    shares = counts.withColumn("total_deals", market).filter("is_firm").drop("is_firm")
    return shares.withColumn("share_pct", percent(F.col("deals"), F.col("total_deals")))


def top_share(shares: DataFrame, n: int = 10, pin: str | None = None) -> DataFrame:
    """Share rows of the firms with the largest summed share, plus a pinned firm.

    Sums are compared at six places, so the order of addition cannot change the choice. A firm's rows,
    at most one per calendar month, stay with its sum, so the shares are computed once.
    """
    row = F.struct("month", "deals", "total_deals", "share_pct")
    firms = shares.groupBy("firm").agg(
        F.round(F.sum("share_pct"), 6).alias("summed"), F.collect_list(row).alias("rows")
    )
    return top_and_pinned(firms, "summed", "firm", n, pin).select("firm", F.inline("rows"))


def market_share(
    deals: DataFrame, flt: DealFilter, n: int = 10, share_base: str = "deals"
) -> DataFrame:
    """Monthly market share of the top firms; no firm is pinned."""
    return top_share(firm_month_share(normalized(deals, flt), share_base), n)


def active_agents(deals: DataFrame, brokerage: DataFrame, flt: DealFilter) -> DataFrame:
    """Distinct agents per firm and month, for firms that have monthly headcount data.

    A firm qualifies with one month found in both tables. The window that spreads this over the
    firm's months holds at most one row per calendar month.
    """
    sides = with_month(deal_sides(normalized(deals, flt), "sold_date", agent=True))
    counts = (
        sides.dropna(subset=["firm", "month"])
        .groupBy("firm", "month")
        .agg(F.count_distinct("agent").alias("active_agents"))
    )
    heads = average_headcount(brokerage, flt).select("firm", "month", F.lit(True).alias("_staffed"))
    marked = counts.join(heads, ["firm", "month"], "left").withColumn(
        "_qualifies", F.bool_or("_staffed").over(Window.partitionBy("firm"))
    )
    return marked.filter("_qualifies").select("firm", "month", "active_agents")


def active_agents_table(deals: DataFrame, brokerage: DataFrame, flt: DealFilter) -> DataFrame:
    """:func:`active_agents` with one column per month of the filter, such as ``Jan-2024``."""
    require_dates(flt, "the month columns")
    months = months_touched(flt.start, flt.end)
    labels = [m.strftime("%b-%Y") for m in months]
    counts = active_agents(deals, brokerage, flt)
    return pivot_sum(counts, "firm", "month", months, labels, "active_agents")


def active_agents_labelled(deals: DataFrame, brokerage: DataFrame, flt: DealFilter) -> DataFrame:
    """:func:`active_agents` in long form with the month label."""
    found = active_agents(deals, brokerage, flt)
    return found.withColumn("month_label", month_label(F.col("month")))


def agent_firms(deals: DataFrame, flt: DealFilter) -> DataFrame:
    """Agent to firm: the first firm by date; the buyer side overrides the listing side."""
    return _first_firms(_agent_sides(normalized(deals, flt)))


def _agent_sides(deals: DataFrame) -> DataFrame:
    return deal_sides(deals, "sold_date", "listing_id", agent=True)


def _first_order() -> Column:
    # Buyer rows (is_listing = false) sort first, which is the override.
    return day_and_id("sold_date", "listing_id", F.col("is_listing"))


def _first_firms(sides: DataFrame) -> DataFrame:
    return first_value_per_key(sides, "agent", "firm", _first_order())


def _agent_league(deals: DataFrame, counted: Column, n: int) -> DataFrame:
    """Top agents with their firm.

    The sides are reduced to one row per agent and firm, with counts and the smallest order key; a
    second pass for the firms of the top agents would read and join the deals again. Windows over an
    agent's few firms then give its totals and first firm.
    """
    pairs = (
        _agent_sides(deals)
        .dropna(subset=["agent"])
        .groupBy("agent", "firm")
        .agg(
            F.count_if("is_listing").alias("n_listing"),
            F.count_if(~F.col("is_listing")).alias("n_buyer"),
            F.min(_first_order()).alias("_order"),
        )
    )
    of_agent = Window.partitionBy("agent")
    by_order = of_agent.orderBy(F.col("firm").isNull(), "_order", "firm")
    agents = pairs.withColumns(
        {
            "_rn": F.row_number().over(by_order),
            "n_listing": F.sum("n_listing").over(of_agent),
            "n_buyer": F.sum("n_buyer").over(of_agent),
        }
    ).filter("_rn = 1")
    found = agents.withColumn("deals", counted).filter(F.col("deals") > 0)
    return top_n(found, "deals", "agent", n=n).select(
        "agent",
        title_case(F.col("agent")).alias("agent_label"),
        "deals",
        F.coalesce("firm", F.lit(UNKNOWN_FIRM)).alias("firm"),
    )


def top_agents(deals: DataFrame, flt: DealFilter, side: str, n: int = 10) -> DataFrame:
    """Agents with most deals on one side. ``side``: listing or buyer."""
    return _agent_league(normalized(deals, flt), F.col(f"n_{side}"), n)


def top_combined_agents(deals: DataFrame, flt: DealFilter, n: int = 10) -> DataFrame:
    """Agents with most deals among those seen on both sides."""
    return _agent_league(normalized(deals, flt), both_sides_total(), n)
