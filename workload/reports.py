"""Report queries R1 to R58 over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.operators.filters import DealFilter
from dealspan.plans import agent, brokerage, brokers, choices, focus, january, market
from dealspan.sources import profile
from workload import views
from workload.views import AGENT, END, FOCUS, START, YEARS

Query = Callable[[SparkSession, str], DataFrame]

WINDOW = DealFilter(start=START, end=END)
MARKET = DealFilter(start=START, end=END, days_on_market=(0, 1000), bedrooms=(1, 5))
THREE_YEARS = DealFilter(start=START.replace(year=1997), end=END.replace(year=1999))
JANUARY = january.month_filter(YEARS)

PROFILE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
PROFILE_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so that both engines print the same value."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: F.round(F.col(n), places) for n in names}) if names else df


def over(columns: str, plan: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A report over deals with the columns it needs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(plan(views.deals(spark, sf_dir, *columns.split()), *args, **kwargs))

    return run


def over_both(columns: str, plan: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A report over deals and headcounts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        deals = views.deals(spark, sf_dir, *columns.split())
        return rounded(plan(deals, views.brokerage(spark, sf_dir), *args, **kwargs))

    return run


def shown_order(df: DataFrame) -> DataFrame:
    """A short sorted table with each row's place as it comes, so that its order can be checked too."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(Window.orderBy("_id"))).drop("_id")


def _schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: views.read(spark, sf_dir, name) for name in PROFILE_TABLES}
    return profile.profile_tables(tables, PROFILE_KEYS)


FIRMS = "sold_date listing_firm buyer_firm"
AGENTS = "sold_date listing_id listing_firm buyer_firm listing_agent buyer_agent"
MINE = "sold_date listing_firm buyer_firm"
SPOT = "sold_date area_city community"


def queries() -> dict[str, Query]:
    return {
        "r01_top_listing_firms": over(
            "sold_date listing_firm sold_price", brokers.top_firms, WINDOW, "listing", FOCUS
        ),
        "r02_top_buyer_firms": over(
            "sold_date buyer_firm sold_price", brokers.top_firms, WINDOW, "buyer", FOCUS
        ),
        "r03_top_combined_firms": over(
            f"{FIRMS} sold_price", brokers.top_combined_firms, WINDOW, FOCUS
        ),
        "r04_average_headcount": lambda spark, sf: rounded(
            brokers.average_headcount(views.brokerage(spark, sf), WINDOW)
        ),
        "r05_deals_per_agent": over_both(FIRMS, brokers.deals_per_agent, WINDOW, FOCUS),
        "r06_market_share_top_firms": over(FIRMS, brokers.market_share, WINDOW),
        "r07_active_agents_table": over_both(
            f"{FIRMS} listing_agent buyer_agent", brokers.active_agents_table, WINDOW
        ),
        "r07_active_agents_long": over_both(
            f"{FIRMS} listing_agent buyer_agent", brokers.active_agents_labelled, WINDOW
        ),
        "r08_agent_firms": over(AGENTS, brokers.agent_firms, WINDOW),
        "r09_top_listing_agents": over(AGENTS, brokers.top_agents, WINDOW, "listing"),
        "r10_top_buyer_agents": over(AGENTS, brokers.top_agents, WINDOW, "buyer"),
        "r11_top_combined_agents": over(AGENTS, brokers.top_combined_agents, WINDOW),
        "r12_market_key_figures": over(
            "sold_date sold_price days_on_market total_bedrooms total_flr_area_sf",
            market.key_figures,
            WINDOW,
        ),
        "r12_market_key_figures_filtered": over(
            "sold_date sold_price days_on_market total_bedrooms total_flr_area_sf",
            market.key_figures,
            MARKET,
        ),
        "r13_price_trend": over("sold_date list_price sold_price", market.price_trend, WINDOW),
        "r14_style_trend": over("sold_date style sold_price", market.style_trend, WINDOW),
        "r15_style_totals": over("sold_date style sold_price", market.style_totals, WINDOW),
        "r16_dom_price_heatmap": over(
            "sold_date days_on_market sold_price", market.dom_price_heatmap, WINDOW
        ),
        "r17_community_metrics": over(
            "sold_date community sold_price days_on_market listing_firm",
            market.community_table,
            WINDOW,
        ),
        "r18_busiest_communities": over(
            "sold_date community sold_price days_on_market listing_firm",
            market.busiest_communities,
            WINDOW,
        ),
        "r18_busiest_order": over(
            "sold_date community sold_price days_on_market listing_firm",
            lambda d: shown_order(market.busiest_communities(d, WINDOW)).select("position", "community", "number_of_sales"),
        ),
        "r17_community_order": over(
            "sold_date community sold_price days_on_market listing_firm",
            lambda d: shown_order(market.community_table(d, WINDOW)).select("position", "community", "number_of_sales"),
        ),
        "r19_transactions": over(" ".join(market.DETAIL_COLUMNS), market.transactions, WINDOW),
        "r19_transactions_raw": over(
            " ".join(views.COLUMNS), market.transactions, WINDOW, all_columns=True
        ),
        "r20_focus_key_figures": over(
            f"{MINE} sold_price days_on_market sold_list_ratio", focus.key_figures, WINDOW, FOCUS
        ),
        "r21_focus_share_of_deals": over(MINE, focus.share_of_deals, WINDOW, FOCUS),
        "r22_focus_property_classes": over(
            f"{MINE} property_class", focus.by_property_class, WINDOW, FOCUS
        ),
        "r23_focus_communities_by_volume": over(
            f"{MINE} community sold_price", focus.top_communities_by_volume, WINDOW, FOCUS
        ),
        "r24_focus_communities_by_count": over(
            f"{MINE} community", focus.top_communities_by_count, WINDOW, FOCUS
        ),
        "r25_focus_monthly_trend": over(
            f"{MINE} listing_id days_on_market", focus.monthly_trend, WINDOW, FOCUS
        ),
        "r26_focus_seasonal_dom": over(
            f"{MINE} days_on_market", focus.seasonal_dom, THREE_YEARS, FOCUS
        ),
        "r27_focus_role_shares": over(MINE, focus.role_shares, WINDOW, FOCUS),
        "r28_competitor_roles": over(MINE, focus.competitor_roles, WINDOW, FOCUS),
        "r29_focus_agent_activity": over(
            f"{MINE} listing_agent buyer_agent", focus.agent_activity, WINDOW, FOCUS
        ),
        "r30_focus_top_listing_agents": over(
            f"{MINE} listing_id sold_price listing_agent", focus.top_agents, WINDOW, FOCUS, "listing"
        ),
        "r31_focus_top_buyer_agents": over(
            f"{MINE} listing_id sold_price buyer_agent", focus.top_agents, WINDOW, FOCUS, "buyer"
        ),
        "r32_focus_bottom_listing_agents": over(
            "sold_date listing_firm listing_id sold_price listing_agent",
            focus.bottom_agents, WINDOW, FOCUS, "listing",
        ),
        "r33_focus_bottom_buyer_agents": over(
            "sold_date buyer_firm listing_id sold_price buyer_agent",
            focus.bottom_agents, WINDOW, FOCUS, "buyer",
        ),
        "r34_agent_ranking": over("listing_agent buyer_agent", agent.ranking),
        "r35_agent_key_figures": over(
            "sold_date listing_agent buyer_agent sold_price", agent.key_figures, WINDOW, AGENT
        ),
        "r36_agent_firms_text": over(
            f"{FIRMS} listing_agent buyer_agent", agent.firms_text, WINDOW, AGENT
        ),
        "r37_agent_monthly_deals": over(
            "sold_date listing_agent buyer_agent", agent.monthly_deals, WINDOW, AGENT
        ),
        "r38_agent_communities": over(
            f"{SPOT} listing_agent buyer_agent", agent.deals_by_community, WINDOW, AGENT
        ),
        "r39_january_sales": over(SPOT, january.sales_by_year, JANUARY),
        "r40_january_prices": over(f"{SPOT} sold_price list_price", january.prices_by_year, JANUARY),
        "r41_january_bedrooms": over(
            f"{SPOT} total_bedrooms", january.frequency_by_year, JANUARY, "total_bedrooms"
        ),
        "r42_january_area_histogram": over(
            f"{SPOT} total_flr_area_sf", january.area_histogram, JANUARY
        ),
        "r43_january_class_share": over(
            f"{SPOT} property_class", january.property_class_share, JANUARY
        ),
        "r44_january_classes": over(
            f"{SPOT} property_class", january.frequency_by_year, JANUARY, "property_class"
        ),
        "r45_january_styles": over(f"{SPOT} style", january.frequency_by_year, JANUARY, "style"),
        "r46_january_ages": over(f"{SPOT} year_built", january.age_by_year, JANUARY),
        "r47_community_ages": over(f"{SPOT} year_built", january.community_age, JANUARY),
        "r48_community_bedrooms": over(
            f"{SPOT} total_bedrooms", january.community_frequency, JANUARY, "total_bedrooms"
        ),
        "r49_community_baths": over(
            f"{SPOT} total_baths", january.community_frequency, JANUARY, "total_baths"
        ),
        "r50_community_area_ranges": over(
            f"{SPOT} total_flr_area_sf", january.community_area_ranges, JANUARY
        ),
        "r51_community_dom_ranges": over(
            f"{SPOT} days_on_market", january.community_dom_ranges, JANUARY
        ),
        "r52_period_totals": over("sold_date listing_firm", brokerage.period_totals, WINDOW),
        "r53_market_share_pinned": over(FIRMS, brokerage.market_share, WINDOW, FOCUS),
        "r53_market_share_by_sides": over(
            FIRMS, brokerage.market_share, WINDOW, FOCUS, share_base="sides"
        ),
        "r54_top_brokerages_any_side": over(FIRMS, brokerage.top_brokerages, WINDOW, FOCUS),
        "r55_top_brokerages_listing": over(
            "sold_date listing_firm", brokerage.top_brokerages_by_side, WINDOW, "listing", FOCUS
        ),
        "r56_top_brokerages_buyer": over(
            "sold_date buyer_firm", brokerage.top_brokerages_by_side, WINDOW, "buyer", FOCUS
        ),
        "r57_option_lists": over(
            "area_city community property_class building_type year_built "
            "listing_firm buyer_firm listing_agent buyer_agent",
            choices.option_lists,
        ),
        "r57_bounds": over(" ".join(choices.BOUND_COLUMNS), choices.bounds),
        "r58_schema_profile": _schema_profile,
    }
