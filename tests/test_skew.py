"""A firm with 40 % of the rows: results equal a plain Python count, whole and exact."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealspan.operators import ranking
from dealspan.operators.filters import DealFilter
from dealspan.plans import agent, brokerage, brokers, market
from dealspan.sources import sinks

YEAR = DealFilter(start=date(2024, 1, 1), end=date(2024, 12, 31))
ROWS = 20_000
COLUMNS = "listing_id string, sold_date date, sold_price decimal(18,4), days_on_market int, community string, listing_firm string, buyer_firm string, listing_agent string, buyer_agent string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)

    def firm():
        return "hot" if rnd.random() < 0.4 else rnd.choice([None, *[f"firm {i}" for i in range(50)]])

    made = []
    for i in range(ROWS):
        made.append(
            (
                str(i), date(2024, 1, 1) + timedelta(days=rnd.choice([0, 0, rnd.randrange(366)])),
                Decimal(rnd.randrange(10**6)) / 100, rnd.randrange(1100),
                rnd.choice(["hot place", "hot place", f"place {rnd.randrange(30)}"]),
                firm(), firm(), f"agent {rnd.randrange(200)}", f"agent {rnd.randrange(200)}",
            )
        )
    return made


@pytest.fixture(scope="module")
def deals(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(16).persist()


def test_brokerage_totals(deals, rows):
    counts = Counter(f for r in rows for f in (r[5], r[6]) if f)
    got = {r.firm: r.total_deals for r in brokerage.top_brokerages(deals, YEAR, n=1000).collect()}
    assert got == counts


def test_half_credit(deals, rows):
    want = defaultdict(Decimal)
    for r in rows:
        if r[5] is not None and r[5] == r[6]:
            want[r[5]] += r[2] / 2
        else:
            for f in (r[5], r[6]):
                if f:
                    want[f] += r[2]
    got = {r.firm: r.gross_sales for r in brokers.top_combined_firms(deals, YEAR, n=1000).collect()}
    assert got == want


def test_market_share(deals, rows):
    months = Counter(r[1].month for r in rows)
    sides = Counter((f, r[1].month) for r in rows for f in (r[5], r[6]) if f)
    got = {(r.firm, r.month.month): r.share_pct for r in brokerage.market_share(deals, YEAR, n=1000).collect()}
    assert got == pytest.approx({k: n / months[k[1]] * 100 for k, n in sides.items()})


def test_agent_ranks(deals, rows):
    counts = Counter(a for r in rows for a in (r[7], r[8]))
    places = {n: i for i, n in enumerate(sorted(set(counts.values()), reverse=True), 1)}
    got = {r.agent: (r.total_deals, r.ranking) for r in agent.ranking(deals).collect()}
    assert got == {a: (n, places[n]) for a, n in counts.items()}


def test_community_metrics(deals, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[4]].append(r)
    for r in market.community_metrics(deals, YEAR).collect():
        own = groups.pop(r.community)
        firms = Counter(x[5] for x in own if x[5])
        best = min(firms, key=lambda f: (-firms[f], f))
        assert (r.number_of_sales, r.total_volume, r.top_selling_firm) == (len(own), sum(x[2] for x in own), best)
        assert r.average_dom == pytest.approx(sum(x[3] for x in own) / len(own))
    assert not groups


def test_best_row_and_first_firm(deals, rows):
    best = ranking.best_per_key(deals.dropna(subset=["listing_firm"]), ["listing_firm"], [F.desc("sold_price"), "listing_id"])
    got = {r.listing_firm: r.listing_id for r in best.collect()}
    want = {}
    for r in sorted((r for r in rows if r[5]), key=lambda r: (-r[2], r[0])):
        want.setdefault(r[5], r[0])
    assert got == want


def test_row_numbers_over_a_hot_date(deals, rows):
    numbered = sinks.with_row_number(deals, ["sold_date", "listing_id"])
    got = {r.listing_id: r.row_index for r in numbered.select("listing_id", "row_index").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_upsert_of_a_hot_key(deals):
    folded = deals.withColumn("key", F.coalesce("listing_firm", F.lit("none")))
    merged = sinks.upsert(folded.filter("days_on_market < 500"), folded.filter("days_on_market >= 500"), ["key"], [F.desc("sold_date"), F.desc("listing_id")])
    assert merged.groupBy("key").count().filter("count > 1").collect() == []
