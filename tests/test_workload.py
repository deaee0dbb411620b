"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from workload import compare, views

SF = "/root/testdata/sf0.001"
OWN = re.compile(r"[a-z]\d\d_")  # the document operators have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if OWN.match(k)}
CHECKS = {k: v for k, v in entry.oracle_sql().items() if OWN.match(k)}

# Operator ids of the survey: prefix and the highest number.
INVENTORY = {"s": 17, "c": 28, "f": 14, "j": 11, "a": 26, "w": 3, "l": 6, "u": 2, "r": 58}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_operator_has_a_query_and_sql():
    found = {name.split("_")[0] for name in QUERIES}
    wanted = {f"{prefix}{no:02d}" for prefix, top in INVENTORY.items() for no in range(1, top + 1)}
    assert found == wanted
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    problem, _ = compare.compare(df, con, CHECKS[name])
    assert problem == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert banned not in plan, f"{banned} in the plan of {name}"


def test_view_joins_only_what_is_asked(spark):
    plan = lambda *c: views.deals(spark, SF, *c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("sold_date", "sold_price", "listing_agent")
    assert plan("listing_firm").count("Join Inner") == 1
    assert plan("area_city").count("Join Inner") == 4


def test_dates_and_columns_reach_the_scan(spark):
    df = QUERIES["r13_price_trend"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[IsNotNull\(l_shipdate\), GreaterThanOrEqual\(l_shipdate", plan)
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["r01_top_listing_firms", "r54_top_brokerages_any_side", "r30_focus_top_listing_agents"])
def test_top_lists_do_not_sort_everything(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_best_row_is_limited_before_the_shuffle(spark):
    plan = QUERIES["w03_best_per_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["firm", "listing_deals", "buyer_deals", "total_deals", "is_focus"]
    assert df.count() > 0


def test_grid_size(spark):
    rows = QUERIES["j09_complete_grid"](spark, SF)
    agents = views.deals(spark, SF, "listing_agent").distinct().count()
    assert rows.count() == agents * 12


def test_shares_by_sides_add_up(spark):
    from dealspan.plans import brokerage
    from workload.reports import WINDOW

    deals = views.deals(spark, SF, "sold_date", "listing_firm", "buyer_firm")
    rows = brokerage.market_share(deals, WINDOW, n=10**6, share_base="sides")
    sums = [r.s for r in rows.groupBy("month").agg({"share_pct": "sum"}).toDF("month", "s").collect()]
    assert sums and all(s == pytest.approx(100) for s in sums)


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture
def shuffled(spark):
    """Tables too large to broadcast, and hot partitions split."""
    before = {k: spark.conf.get(k, None) for k in SHUFFLED}
    for key, value in SHUFFLED.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    [
        "r03_top_combined_firms", "r05_deals_per_agent", "r07_active_agents_long",
        "r17_community_metrics", "r28_competitor_roles", "r34_agent_ranking",
        "r42_january_area_histogram", "r48_community_bedrooms", "r53_market_share_pinned",
        "j09_complete_grid", "s09_keyed_upsert",
    ],
)
def test_results_hold_without_broadcasts(spark, con, shuffled, name):
    problem, _ = compare.compare(QUERIES[name](spark, SF), con, CHECKS[name])
    assert problem == ""


def test_stored_deals_give_the_same_reports(spark, tmp_path):
    """Export as text, clean, store by year, scan one window: reports equal the direct ones."""
    from dealspan.plans import brokerage, market
    from dealspan.sources import ingest, readers, sinks
    from workload.reports import WINDOW

    direct = views.deals(spark, SF)
    text, stored = str(tmp_path / "text"), str(tmp_path / "deals")
    export = ingest.export_text(direct)
    sinks.export_csv(export, text)
    sinks.write_deals(ingest.clean_deals(readers.read_csv(spark, text, export.schema)), stored)
    scanned = readers.scan_table(spark, stored, WINDOW.start, WINDOW.end)
    for report in (brokerage.top_brokerages, brokerage.market_share, market.community_metrics):
        assert sorted(report(scanned, WINDOW).collect()) == sorted(report(direct, WINDOW).collect())


def nodes_that_ran(node):
    """The nodes of a final plan and its subqueries; what is reused is there once."""
    name = node.nodeName()
    if name.startswith("Reused"):
        return []
    if name == "AdaptiveSparkPlan":
        return nodes_that_ran(node.executedPlan())
    if name.endswith("QueryStage"):
        return nodes_that_ran(node.plan())
    below = [seq.apply(i) for seq in (node.children(), node.subqueries()) for i in range(seq.size())]
    return [node, *(x for child in below for x in nodes_that_ran(child))]


def final_plan(df):
    df.collect()
    return [n.simpleString(100) for n in nodes_that_ran(df._jdf.queryExecution().executedPlan())]


@pytest.mark.parametrize(
    "name",
    [
        "r05_deals_per_agent", "r06_market_share_top_firms", "r53_market_share_pinned", "r53_market_share_by_sides",
        "j02_join_month_totals", "j09_complete_grid", "r11_top_combined_agents", "r16_dom_price_heatmap", "r28_competitor_roles",
        "r42_january_area_histogram", "a20_histogram_2d", "a21_histogram_by_year", "r57_option_lists",
    ],
)
def test_deals_are_read_once(spark, name):
    # the headcount view reads the months of lineitem, which deals per agent needs besides
    scans = [n for n in final_plan(QUERIES[name](spark, SF)) if "FileScan parquet [l_" in n]
    assert len(scans) == (2 if name.startswith("r05") else 1)


@pytest.mark.parametrize(
    "name",
    ["r08_agent_firms", "r09_top_listing_agents", "r10_top_buyer_agents", "r11_top_combined_agents", "a12_first_value_per_key", "j11_lookup_with_default"],
)
def test_first_firms_stay_in_hash_aggregates(spark, name):
    plan = "\n".join(final_plan(QUERIES[name](spark, SF)))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def _below(plan: str, step: str) -> list[list[str]]:
    """The lines of a plan's tree under each line that holds ``step``."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if step in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            found.append(lines[i + 1 : end])
    return found


@pytest.mark.parametrize("name", ["r57_option_lists"])
def test_customers_are_joined_to_orders_alone(spark, shuffled_joins, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    under = _below(plan, "Exchange hashpartitioning(o_custkey")
    assert under
    assert not any("l_orderkey" in line for lines in under for line in lines)


@pytest.fixture
def shuffled_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_the_export_is_shuffled_without_its_customers(spark, shuffled_joins):
    plan = views.deals(spark, SF, "community", "sold_price", "buyer_firm")._jdf.queryExecution().executedPlan().toString()
    sent = [lines for c in ("l_orderkey", "l_suppkey") for lines in _below(plan, f"Exchange hashpartitioning({c}")]
    assert sent
    assert not any("n_name" in line for lines in sent for line in lines)


def test_firm_months_are_dealt_by_key(spark):
    plan = QUERIES["j01_inner_on_firm_month"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert "partial_count" not in "".join(line for lines in _below(plan, "REPARTITION_BY_NUM") for line in lines if "firm" in line)
