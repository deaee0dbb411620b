"""Report rules that need their own rows: one-sided months, zero headcount, pins, ties, empties."""

from datetime import date
from decimal import Decimal

import pytest

from dealspan.operators.filters import DealFilter
from dealspan.plans import agent, brokerage, brokers, focus, january, market
from dealspan.schema import DEALS

YEAR = DealFilter(start=date(2024, 1, 1), end=date(2024, 12, 31))
BLANK = {f.name: None for f in DEALS}


def table(spark, rows):
    """Deals from partial rows; missing fields are null."""
    base = {"sold_date": date(2024, 1, 10), "sold_price": Decimal(10), "days_on_market": 5}
    full = [{**BLANK, **base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in DEALS) for r in full], DEALS)


def pair(listing, buyer, **more):
    return {"listing_firm": listing, "buyer_firm": buyer, **more}


def test_firm_names_are_folded_and_titled(spark):
    deals = table(spark, [pair(" Re/Max Elite", None), pair("RE/MAX elite ", None), pair("b", None)])
    top = brokers.top_firms(deals, YEAR, "listing", "RE/MAX ELITE").collect()
    first = top[0]
    assert (first.firm, first.office, first.deals) == ("re/max elite", "Re/Max Elite", 2)
    assert (first.gross_sales_text, first.is_focus, top[1].is_focus) == ("$20.00", True, False)


def test_combined_firms_need_both_sides(spark):
    deals = table(spark, [pair("a", "b"), pair("b", "c"), pair("b", "b", sold_price=Decimal(3))])
    got = {r.firm: (r.deals, r.gross_sales) for r in brokers.top_combined_firms(deals, YEAR).collect()}
    assert got == {"b": (4, Decimal("21.5"))}


def headcount(spark, *rows):
    return spark.createDataFrame(rows, "broker string, date date, value double")


def test_deals_per_agent_grid(spark):
    feb = date(2024, 2, 5)
    deals = table(
        spark,
        [pair("a", "a"), pair("a", "x", sold_date=feb), pair("b", "b"), pair("z", "z", sold_date=feb)],
    )
    heads = headcount(
        spark,
        ("A ", date(2024, 1, 1), 2.0), ("a", date(2024, 1, 20), 6.0), ("a", date(2024, 2, 1), 4.0),
        ("b", date(2024, 1, 1), 0.0), ("q", date(2024, 1, 1), 9.0),
    )
    flt = DealFilter(start=date(2024, 1, 1), end=date(2024, 3, 31))
    rows = brokers.deals_per_agent(deals, heads, flt).collect()
    got = {(r.firm, r.month.month): (r.deals, r.avg_agents, r.deals_per_agent) for r in rows}
    assert len(got) == 2 * 3  # brokers in both tables x month starts
    assert got["a", 1] == (2, 4.0, 0.5)
    assert got["a", 2] == (0, 4.0, 0.0)  # on one side only
    assert got["a", 3] == (0, 0.0, 0.0)  # month without data
    assert got["b", 1] == (2, 0.0, 0.0)  # no headcount


def test_deals_per_agent_skips_an_opening_part_month_and_pins(spark):
    deals = table(spark, [pair(f, f) for f in ("a", "a", "b")])
    heads = headcount(spark, ("a", date(2024, 1, 20), 1.0), ("b", date(2024, 1, 20), 1.0))
    flt = DealFilter(start=date(2024, 1, 5), end=date(2024, 2, 29))
    rows = brokers.deals_per_agent(deals, heads, flt, focus_firm="B", n=1).collect()
    assert {(r.firm, r.month) for r in rows} == {("a", date(2024, 2, 1)), ("b", date(2024, 2, 1))}
    absent = brokers.deals_per_agent(deals, heads, flt, focus_firm="nobody", n=1).collect()
    assert {r.firm for r in absent} == {"a"}


def test_market_share_bases_and_pin(spark):
    deals = table(spark, [pair("a", "b"), pair("a", "a"), pair("c", None), pair(None, "b")])
    by_deals = brokerage.market_share(deals, YEAR, "c", n=1).collect()
    assert {r.firm: r.share_pct for r in by_deals} == {"a": 75.0, "c": 25.0}
    by_sides = brokerage.market_share(deals, YEAR, n=10, share_base="sides").collect()
    assert sum(r.share_pct for r in by_sides) == pytest.approx(100)
    assert {r.firm: r.total_deals for r in by_deals} == {"a": 4, "c": 4}  # also deals without a firm


def test_agent_firms_prefer_the_buyer_side(spark):
    deals = table(
        spark,
        [
            pair("l1", "b1", listing_agent="x", buyer_agent="y", listing_id="1"),
            pair("l2", "b2", listing_agent="y", buyer_agent="x", listing_id="2", sold_date=date(2024, 5, 1)),
            pair("l3", None, listing_agent="z", buyer_agent="x", listing_id="3", sold_date=date(2024, 1, 1)),
        ],
    )
    got = {r.agent: r.firm for r in brokers.agent_firms(deals, YEAR).collect()}
    assert got == {"x": "b2", "y": "b1", "z": "l3"}
    no_firm = table(spark, [pair(None, None, listing_agent="solo")])
    assert brokers.top_agents(no_firm, YEAR, "listing").first().firm == "Unknown Firm"


def test_active_agents_counts_both_roles(spark):
    deals = table(
        spark,
        [
            pair("a", "a", listing_agent="x", buyer_agent="y"),
            pair("a", "b", listing_agent="x", buyer_agent=None),
            pair("c", "c", listing_agent="x", buyer_agent="x"),
        ],
    )
    heads = headcount(spark, ("a", date(2024, 1, 1), 1.0), ("b", date(2024, 1, 1), 1.0))
    flt = DealFilter(start=date(2024, 1, 1), end=date(2024, 2, 29))
    wide = brokers.active_agents_table(deals, heads, flt)
    assert wide.columns == ["firm", "Jan-2024", "Feb-2024"]
    assert sorted(tuple(r) for r in wide.collect()) == [("a", 2, 0), ("b", 0, 0)]


def test_community_without_a_firm_keeps_its_row(spark):
    rows = [
        pair("f", None, community="p"), pair("g", None, community="p"), pair(None, None, community="p"),
        pair(None, None, community="q", sold_price=None), pair("f", None, community=None),
    ]
    got = {r.community: r for r in market.community_table(table(spark, rows), YEAR).collect()}
    assert set(got) == {"p", "q"}
    assert (got["p"].top_selling_firm, got["p"].number_of_sales) == ("f", 3)
    assert got["q"].top_selling_firm is None
    assert (got["q"].total_volume, got["q"].average_price_text) == (0, "N/A")


def test_mean_of_style_means(spark):
    rows = [{"style": s, "sold_price": Decimal(p)} for s, p in (("a", 10), ("a", 20), ("b", 100))]
    only = market.style_totals(table(spark, rows), YEAR).first()
    assert (only.total_gross_sales, only.total_sales, only.avg_sales_price) == (130, 3, 57.5)


def test_focus_against_an_empty_market(spark):
    deals = table(spark, [pair("a", "b")])
    figures = focus.key_figures(deals, YEAR, "nobody").first()
    assert (figures.focus_deals, figures.focus_volume, figures.focus_dom) == (0, 0, None)
    assert [r.share_pct for r in focus.role_shares(deals, YEAR, "nobody").collect()] == [None, None]
    activity = focus.agent_activity(deals, YEAR, "nobody").first()
    assert (activity.active_agents, activity.closed_deals, activity.deals_per_agent) == (0, 0, None)


def test_focus_agents(spark):
    deals = table(
        spark,
        [
            pair("f", "f", listing_agent="x", buyer_agent="x", listing_id="1"),
            pair("f", "g", listing_agent="x", buyer_agent="other", listing_id="2"),
            pair("g", "f", listing_agent="other", buyer_agent="y", listing_id="3"),
        ],
    )
    activity = focus.agent_activity(deals, YEAR, "f").first()
    assert (activity.active_agents, activity.closed_deals) == (2, 3)
    top = {r.agent: r.deals for r in focus.top_agents(deals, YEAR, "f", "listing").collect()}
    assert top == {"x": 2, "other": 1}  # the other firm's agent counts
    own = {r.agent: r.deals for r in focus.bottom_agents(deals, YEAR, "f", "listing").collect()}
    assert own == {"x": 2}


def test_competitors_exclude_the_focus_firm_and_missing_firms(spark):
    rows = [pair("f", "a")] * 5 + [pair(None, "a")] * 4 + [pair("a", "b")] * 3 + [pair("b", "a")] * 2 + [pair("c", "a")]
    got = {r.role: r.avg_deals for r in focus.competitor_roles(table(spark, rows), YEAR, "f", n=2).collect()}
    assert got == {"Listing Firm": 2.5, "Buyer Firm": 2.5}


def test_seasonal_table_keeps_every_month(spark):
    rows = [pair("f", None, sold_date=date(2024, 3, 1), days_on_market=d) for d in (10, 20)]
    found = focus.seasonal_dom(table(spark, rows), DealFilter(start=date(2023, 1, 1), end=date(2024, 12, 31)), "f")
    got = found.collect()
    assert [r.month for r in got][:3] == ["January", "February", "March"]
    assert (len(got), got[2].y2024, got[2].y2023, got[0].y2024) == (12, 15.0, None, None)


def test_agent_reports(spark):
    deals = table(
        spark,
        [
            pair("f", "g", listing_agent="x", buyer_agent="y", community="p", area_city="c"),
            pair("h", "f", listing_agent="y", buyer_agent="x", community="p", area_city="c"),
            pair("f", "f", listing_agent="x", buyer_agent="x"),
        ],
    )
    ranks = {r.agent: (r.total_deals, r.ranking) for r in agent.ranking(deals).collect()}
    assert ranks == {"x": (4, 1), "y": (2, 2)}
    assert agent.firms_text(deals, YEAR, "y").first().firms == "g, h"
    assert agent.deals_by_community(deals, YEAR, "x").first().deals == 2
    nobody = agent.key_figures(deals, YEAR, "nobody").first()
    assert (nobody.total_deals, nobody.gross_sales, nobody.avg_price_per_deal) == (0, 0, 0)


def test_january_needs_a_place(spark):
    place = {"community": "p", "area_city": "c"}
    rows = [place, {**place, "sold_date": date(2023, 1, 31)}, {"community": "p"}, {**place, "sold_date": date(2024, 2, 1)}]
    flt = january.month_filter((2023, 2024))
    got = {r.year: r.properties_sold for r in january.sales_by_year(table(spark, rows), flt).collect()}
    assert got == {2023: 1, 2024: 1}


def test_top_communities_count_deals_without_a_value(spark):
    place = {"area_city": "c"}
    rows = [{**place, "community": "p", "total_bedrooms": None}] * 3
    rows += [{**place, "community": "q", "total_bedrooms": 2}] * 2
    rows += [{**place, "community": "r", "total_bedrooms": 1}]
    flt = january.month_filter((2024,))
    found = january.community_frequency(table(spark, rows), flt, "total_bedrooms", n=2).collect()
    assert [tuple(r) for r in found] == [("q", 2, 2)]


def test_empty_window_gives_empty_typed_tables(spark):
    deals = table(spark, [pair("a", "b")])
    never = DealFilter(start=date(1900, 1, 1), end=date(1900, 12, 31))
    found = brokerage.top_brokerages(deals, never, "a")
    assert found.collect() == [] and dict(found.dtypes)["total_deals"] == "bigint"
    gone = brokerage.top_brokerages_by_side(deals.drop("buyer_firm"), YEAR, "buyer")
    assert gone.collect() == []


def test_totals_over_any_side_cover_both_sides(spark):
    rows = [pair(a, b) for a in "abc" for b in "bcd"]
    deals = table(spark, rows)
    every = {r.firm: r.total_deals for r in brokerage.top_brokerages(deals, YEAR).collect()}
    both = {r.firm: r.deals for r in brokers.top_combined_firms(deals, YEAR).collect()}
    assert set(both) < set(every) and all(every[f] >= n for f, n in both.items())
