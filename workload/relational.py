"""Queries F, J, A, W, L and U: filters, joins, aggregates, ranks, limits and unions over whole
tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.functions.bins import DOM_EDGES, DOM_LABELS
from dealspan.functions.dates import MONTH_NAMES, months_between
from dealspan.functions.numbers import mean, percent, ratio, ratio_or_zero, total
from dealspan.operators import filters, grouping, ranking, sides
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import count_by, with_month
from dealspan.plans import agent, brokers, focus
from dealspan.schema import DISPLAY_NAMES
from dealspan.sources.readers import preview, to_display_names
from workload import views
from workload.reports import Query, rounded, shown_order
from workload.sql_base import cut, mean as sql_mean, sql, total as sql_total
from workload.views import AGENT, END, FOCUS, START, YEARS

Entry = tuple[Query, str]

MONTHS = months_between(START, END)
SIDES_OF_A_TASK = 1_000_000
LAST_MONTH = MONTHS[-1]
CITIES = ("ASIA", "EUROPE")
FIRMS = (FOCUS, "Supplier#000000002")
FULL = DealFilter(
    start=START, end=END, cities=CITIES, building_types=("BUILDING", "MACHINERY"),
    price=(20000, 90000), days_on_market=(0, 1000), baths=(0, 3), bedrooms=(1, 5),
    transaction=filters.BUYER,
)


def _over(columns: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(plan(views.deals(spark, sf, *columns.split())))


def _by(flt: DealFilter, key: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: count_by(flt.apply(d), key)


def _counted(where: str, key: str) -> str:
    return sql(
        f"SELECT {key}, count(*) AS deals FROM deals WHERE {where} AND {key} IS NOT NULL GROUP BY 1"
    )


def _transactions(d: DataFrame) -> DataFrame:
    kinds = (filters.LISTING, filters.BUYER, filters.DUAL)
    hits = [
        F.struct(
            F.lit(k).alias("kind"),
            F.coalesce(DealFilter(transaction=k).conditions()[0], F.lit(False)).alias("hit"),
        )
        for k in kinds
    ]
    return d.select(F.inline(F.array(*hits))).groupBy("kind").agg(F.count_if("hit").alias("deals"))


def _sides(d: DataFrame, *carry: str, **kinds: bool) -> DataFrame:
    return sides.deal_sides(d, *carry, **kinds)


def _firm_counts(d: DataFrame) -> DataFrame:
    return sides.side_counts(_sides(d), "firm")


def _firm_months(d: DataFrame) -> DataFrame:
    return sides.side_counts(with_month(_sides(d, "sold_date")), "firm", "month")


def filter_entries() -> dict[str, Entry]:
    window = f"sold_date BETWEEN DATE '{START}' AND DATE '{END}'"
    firms = ", ".join(f"'{f}'" for f in FIRMS)
    cities = ", ".join(f"'{c}'" for c in CITIES)
    years = ", ".join(map(str, YEARS))
    return {
        "f01_date_range": (
            _over("sold_date", _by(DealFilter(start=START, end=END), "sold_date")),
            _counted(window, "sold_date"),
        ),
        "f02_optional_in": (
            _over("area_city community", _by(DealFilter(cities=CITIES), "community")),
            _counted(f"area_city IN ({cities})", "community"),
        ),
        "f03_either_side_in": (
            _over("listing_firm buyer_firm style", _by(DealFilter(firms=FIRMS), "style")),
            _counted(f"(listing_firm IN ({firms}) OR buyer_firm IN ({firms}))", "style"),
        ),
        "f04_either_side_is": (
            _over(
                "listing_agent buyer_agent sold_date",
                lambda d: count_by(
                    d.filter(filters.either_is("listing_agent", "buyer_agent", AGENT)), "sold_date"
                ),
            ),
            _counted(f"(listing_agent = '{AGENT}' OR buyer_agent = '{AGENT}')", "sold_date"),
        ),
        "f05_numeric_range": (
            _over(
                "sold_price days_on_market total_baths",
                _by(DealFilter(price=(20000, 60000), days_on_market=(10, 500)), "total_baths"),
            ),
            _counted(
                "sold_price BETWEEN 20000 AND 60000 AND days_on_market BETWEEN 10 AND 500",
                "total_baths",
            ),
        ),
        "f06_transaction_type": (
            _over("listing_firm buyer_firm", _transactions),
            sql("""SELECT 'listing' AS kind, count(listing_firm) AS deals FROM deals
                UNION ALL SELECT 'buyer', count(buyer_firm) FROM deals
                UNION ALL SELECT 'dual', count(*) FROM deals WHERE listing_firm = buyer_firm"""),
        ),
        "f07_conjunction": (
            _over(
                "sold_date area_city building_type sold_price days_on_market total_baths "
                "total_bedrooms buyer_firm style",
                _by(FULL, "style"),
            ),
            _counted(
                f"{window} AND area_city IN ({cities}) AND building_type IN ('BUILDING', 'MACHINERY')"
                " AND sold_price BETWEEN 20000 AND 90000 AND days_on_market BETWEEN 0 AND 1000"
                " AND total_baths BETWEEN 0 AND 3 AND total_bedrooms BETWEEN 1 AND 5"
                " AND buyer_firm IS NOT NULL",
                "style",
            ),
        ),
        "f08_month_and_years": (
            _over("sold_date", _by(DealFilter(month=1, years=YEARS), "sold_date")),
            _counted(f"month(sold_date) = 1 AND year(sold_date) IN ({years})", "sold_date"),
        ),
        "f09_exclude_firm": (
            _over(
                "buyer_firm total_baths",
                lambda d: count_by(d.filter(filters.differs("buyer_firm", F.lit(FOCUS))), "total_baths"),
            ),
            _counted(f"buyer_firm IS DISTINCT FROM '{FOCUS}'", "total_baths"),
        ),
        "f10_one_side_is": (
            _over(
                "buyer_firm listing_firm",
                lambda d: count_by(d.filter(F.col("buyer_firm") == FOCUS), "listing_firm"),
            ),
            _counted(f"buyer_firm = '{FOCUS}'", "listing_firm"),
        ),
        "f11_project_and_rename": (
            _over("listing_id sold_date sold_price listing_agent", to_display_names),
            sql(
                "SELECT "
                + ", ".join(
                    f'{c} AS "{DISPLAY_NAMES[c]}"'
                    for c in ("listing_id", "sold_date", "sold_price", "listing_agent")
                )
                + " FROM deals"
            ),
        ),
        "f12_options": (
            _over("style", lambda d: filters.options(d, "style")),
            sql("SELECT DISTINCT style FROM deals WHERE style IS NOT NULL"),
        ),
        "f12_options_order": (
            _over("style", lambda d: shown_order(filters.options(d, "style"))),
            sql("""SELECT style, CAST(row_number() OVER (ORDER BY style) AS INTEGER) AS position
                FROM (SELECT DISTINCT style FROM deals WHERE style IS NOT NULL)"""),
        ),
        "f13_options_of_two_columns": (
            _over(
                "listing_firm buyer_firm",
                lambda d: filters.options_union(d, "listing_firm", "buyer_firm", "firm"),
            ),
            sql("SELECT DISTINCT firm FROM all_sides WHERE firm IS NOT NULL"),
        ),
        "f14_cascading_options": (
            _over("area_city community", lambda d: filters.communities_of(d, CITIES)),
            sql(f"SELECT DISTINCT community FROM deals WHERE area_city IN ({cities})"),
        ),
    }


def join_entries() -> dict[str, Entry]:
    month = "CAST(date_trunc('month', sold_date) AS DATE)"
    counts = """,
        c AS (SELECT firm, count(*) FILTER (WHERE is_listing) AS n_listing,
          count(*) FILTER (WHERE NOT is_listing) AS n_buyer
          FROM all_sides WHERE firm IS NOT NULL GROUP BY 1)"""
    firm_months = """,
        c AS (SELECT firm, month, count(*) FILTER (WHERE is_listing) AS n_listing,
          count(*) FILTER (WHERE NOT is_listing) AS n_buyer
          FROM all_sides WHERE firm IS NOT NULL GROUP BY 1, 2)"""

    def staffed(spark, sf):
        deals = views.deals(spark, sf, "sold_date", "listing_firm", "buyer_firm")
        heads = views.brokerage(spark, sf).select(
            F.col("broker").alias("firm"), F.col("date").alias("month"), "value"
        )
        # Most firms have few deals a month, so that tasks would keep nearly all their rows apart: they are dealt by
        # key first, over tasks whose number grows with the deals, and counted and joined there.
        tasks = max(spark.sparkContext.defaultParallelism, -(-2 * views.read(spark, sf, "lineitem").count() // SIDES_OF_A_TASK))
        dealt = with_month(_sides(deals, "sold_date")).repartition(tasks, "firm", "month")
        return rounded(count_by(dealt, "firm", "month").join(heads.repartition(tasks, "firm", "month"), ["firm", "month"]))

    def with_market(d):
        return grouping.with_market(d, "listing_agent").filter("listing_agent is not null")

    def winners(d):
        found = count_by(d, "community")
        best = ranking.most_frequent(d, "community", "building_type", "top_type")
        return found.join(best, "community", "left")

    def reindexed(d):
        top = ranking.top_n(count_by(d, "listing_firm"), "deals", "listing_firm")
        dual = DealFilter(transaction=filters.DUAL).apply(d)
        both = count_by(dual, "listing_firm", name="dual_deals")
        return top.join(both, "listing_firm", "left").fillna(0, ["dual_deals"])

    def grid(d):
        return grouping.filled_months(d, "listing_agent", MONTHS)

    def semi(d):
        top = ranking.top_keys(count_by(d, "community"), "deals", "community")
        return count_by(ranking.keep_keys(d, top, "community"), "community", "building_type")

    def unknown(d):
        agents = count_by(d.select(F.col("buyer_agent").alias("agent")), "agent")
        recent = DealFilter(start=LAST_MONTH, end=END).apply(d)
        listed = recent.select(
            F.col("listing_agent").alias("agent"), "sold_date", "listing_id",
            F.col("listing_firm").alias("firm"),
        )
        firms = ranking.first_value_per_key(listed, "agent", "firm", ranking.day_and_id("sold_date", "listing_id"))
        return grouping.lookup(agents, firms, "agent", "firm", brokers.UNKNOWN_FIRM)

    two = "listing_firm buyer_firm"
    return {
        "j01_inner_on_firm_month": (
            staffed,
            sql(f"""{firm_months}
                SELECT firm, c.month, n_listing + n_buyer AS deals, value
                FROM c JOIN brokerage b ON b.broker = firm AND b.date = c.month"""),
        ),
        "j02_join_month_totals": (
            _over("sold_date listing_agent", with_market),
            sql(f""",
                m AS (SELECT {month} AS month, count(*) AS total_deals FROM deals GROUP BY 1),
                a AS (SELECT listing_agent, {month} AS month, count(*) AS deals FROM deals GROUP BY 1, 2)
                SELECT listing_agent, month, deals, total_deals FROM a JOIN m USING (month)"""),
        ),
        "j03_left_join_winner": (
            _over("community building_type", winners),
            sql(""",
                w AS (SELECT community, building_type AS top_type, row_number() OVER (
                    PARTITION BY community ORDER BY count(*) DESC, building_type) AS rn
                  FROM deals WHERE building_type IS NOT NULL GROUP BY 1, 2)
                SELECT d.community, d.deals, w.top_type
                FROM (SELECT community, count(*) AS deals FROM deals GROUP BY 1) d
                LEFT JOIN w ON w.community = d.community AND w.rn = 1"""),
        ),
        "j04_outer_counts": (
            _over(two, lambda d: _firm_counts(d).withColumn("deals", sides.any_side_total())),
            sql(f"{counts} SELECT firm, n_listing, n_buyer, n_listing + n_buyer AS deals FROM c"),
        ),
        "j05_both_sides_only": (
            _over(
                "listing_agent buyer_agent",
                lambda d: sides.side_counts(_sides(d, firm=False, agent=True), "agent")
                .filter(sides.on_both_sides())
                .select("agent", sides.any_side_total().alias("deals")),
            ),
            sql("""SELECT agent, count(*) AS deals FROM all_sides WHERE agent IS NOT NULL GROUP BY 1
                HAVING count(*) FILTER (WHERE is_listing) > 0
                  AND count(*) FILTER (WHERE NOT is_listing) > 0"""),
        ),
        "j06_one_sided_months_null": (
            _over(
                f"sold_date {two}",
                lambda d: _firm_months(d).select(
                    "firm", "month", sides.both_sides_total().alias("deals")
                ),
            ),
            sql(f"""{firm_months} SELECT firm, month,
                CASE WHEN n_listing > 0 AND n_buyer > 0 THEN n_listing + n_buyer END AS deals FROM c"""),
        ),
        "j07_any_side_total": (
            _over(
                f"sold_date {two}",
                lambda d: count_by(with_month(_sides(d, "sold_date")), "firm", "month"),
            ),
            sql(f"{firm_months} SELECT firm, month, n_listing + n_buyer AS deals FROM c"),
        ),
        "j08_reindex_to_top": (
            _over(two, reindexed),
            sql(""",
                top AS (SELECT listing_firm, count(*) AS deals FROM deals GROUP BY 1
                  ORDER BY deals DESC, listing_firm LIMIT 10),
                b AS (SELECT listing_firm, count(*) AS dual_deals FROM deals
                  WHERE listing_firm = buyer_firm GROUP BY 1)
                SELECT listing_firm, deals, coalesce(dual_deals, 0) AS dual_deals
                FROM top LEFT JOIN b USING (listing_firm)"""),
        ),
        "j09_complete_grid": (
            _over("sold_date listing_agent", grid),
            sql(f""",
                months AS (SELECT CAST(generate_series AS DATE) AS month FROM
                  generate_series(DATE '{MONTHS[0]}', DATE '{MONTHS[-1]}', INTERVAL 1 MONTH)),
                a AS (SELECT listing_agent, {month} AS month, count(*) AS deals FROM deals GROUP BY 1, 2)
                SELECT listing_agent, month, coalesce(deals, 0) AS deals
                FROM (SELECT DISTINCT listing_agent FROM deals) CROSS JOIN months
                LEFT JOIN a USING (listing_agent, month)"""),
        ),
        "j10_semi_join_top": (
            _over("community building_type", semi),
            sql("""SELECT community, building_type, count(*) AS deals FROM deals WHERE community IN
                (SELECT community FROM deals GROUP BY 1 ORDER BY count(*) DESC, community LIMIT 10)
                GROUP BY 1, 2"""),
        ),
        "j11_lookup_with_default": (
            _over("sold_date listing_id listing_firm listing_agent buyer_agent", unknown),
            sql(f""",
                m AS (SELECT listing_agent, listing_firm, row_number() OVER (PARTITION BY listing_agent
                    ORDER BY sold_date, listing_id, listing_firm) AS rn
                  FROM deals WHERE sold_date BETWEEN DATE '{LAST_MONTH}' AND DATE '{END}')
                SELECT agent, deals, coalesce(listing_firm, 'Unknown Firm') AS firm
                FROM (SELECT buyer_agent AS agent, count(*) AS deals FROM deals
                  WHERE buyer_agent IS NOT NULL GROUP BY 1)
                LEFT JOIN m ON listing_agent = agent AND rn = 1"""),
        ),
    }


def aggregate_entries() -> dict[str, Entry]:
    month = "CAST(date_trunc('month', sold_date) AS DATE)"
    half = """CAST(coalesce(sum(CASE WHEN NOT is_dual THEN CAST(sold_price AS DECIMAL(20,5))
        WHEN is_listing THEN CAST(sold_price * 0.5 AS DECIMAL(20,5)) ELSE 0 END), 0)
        AS DECIMAL(30,5))"""
    pivot_cells = ", ".join(
        f"CAST(coalesce(sum(deals) FILTER (WHERE month = DATE '{m}'), 0) AS BIGINT) "
        f'AS "{m:%b-%Y}"'
        for m in MONTHS
    )
    calendar = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTH_NAMES, 1))
    year_cells = ", ".join(
        f"{sql_mean('days_on_market', f'year(sold_date) = {y}')} AS y{y}" for y in YEARS
    )
    bins = ", ".join(f"({i}, '{x}')" for i, x in enumerate(DOM_LABELS, 1))
    three_years = DealFilter(start=START.replace(year=YEARS[0]), end=END.replace(year=YEARS[-1]))

    def whole(d):
        price = F.col("sold_price")
        return d.agg(
            total(price).alias("sum_price"),
            mean(price).alias("avg_price"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
        )

    def styles(d):
        return (
            with_month(d)
            .groupBy("month", "style")
            .agg(F.count(F.lit(1)).alias("_n"), mean(F.col("sold_price")).alias("_m"))
            .groupBy("month")
            .agg(F.sum("_n").alias("deals"), F.avg("_m").alias("mean_of_means"))
        )

    def per_agent(d):
        found = _sides(sides.with_dual(d), "is_dual", agent=True).dropna(subset=["firm"])
        counts = found.groupBy("firm").agg(
            F.count_distinct("agent").alias("agents"),
            F.count_if(F.col("is_listing") | ~F.col("is_dual")).alias("deals"),
        )
        return counts.withColumn("deals_per_agent", ratio(F.col("deals"), F.col("agents")))

    def against_market(d):
        mine = F.col("listing_firm") == FOCUS
        means = d.agg(
            mean(F.when(mine, F.col("days_on_market"))).alias("focus_dom"),
            mean(F.col("days_on_market")).alias("market_dom"),
        )
        return means.withColumn("delta", F.col("market_dom") - F.col("focus_dom"))

    def month_pivot(d):
        counts = count_by(with_month(DealFilter(start=START, end=END).apply(d)), "community", "month")
        labels = [m.strftime("%b-%Y") for m in MONTHS]
        return grouping.pivot_sum(counts, "community", "month", MONTHS, labels, "deals")

    def roles(d):
        found = _sides(d, agent=True).dropna(subset=["firm"])
        return found.groupBy("firm").agg(F.count_distinct("agent").alias("agents"))

    return {
        "a01_row_count": (
            _over("listing_id", lambda d: d.agg(F.count(F.lit(1)).alias("deals"))),
            sql("SELECT count(*) AS deals FROM deals"),
        ),
        "a02_whole_table_aggregates": (
            _over("sold_price", whole),
            sql(f"""SELECT {sql_total("sold_price")} AS sum_price, {sql_mean("sold_price")} AS avg_price,
                min(sold_price) AS min_price, max(sold_price) AS max_price FROM deals"""),
        ),
        "a03_value_counts": (
            _over("style", lambda d: grouping.value_counts(d, "style")),
            sql("SELECT style, count(*) AS deals FROM deals GROUP BY 1"),
        ),
        "a04_group_size": (
            _over("community building_type", lambda d: count_by(d, "community", "building_type")),
            sql("SELECT community, building_type, count(*) AS deals FROM deals GROUP BY 1, 2"),
        ),
        "a05_group_sum": (
            _over(
                "listing_agent sold_price",
                lambda d: d.groupBy("listing_agent").agg(total(F.col("sold_price")).alias("volume")),
            ),
            sql(f"SELECT listing_agent, {sql_total('sold_price')} AS volume FROM deals GROUP BY 1"),
        ),
        "a06_group_mean": (
            _over(
                "style days_on_market",
                lambda d: d.groupBy("style").agg(mean(F.col("days_on_market")).alias("avg_dom")),
            ),
            sql(f"SELECT style, {sql_mean('days_on_market')} AS avg_dom FROM deals GROUP BY 1"),
        ),
        "a07_several_aggregates": (
            _over(
                "community sold_price days_on_market",
                lambda d: d.groupBy("community").agg(
                    F.count("sold_price").alias("sales"),
                    mean(F.col("sold_price")).alias("avg_price"),
                    total(F.col("sold_price")).alias("volume"),
                    mean(F.col("days_on_market")).alias("avg_dom"),
                ),
            ),
            sql(f"""SELECT community, count(sold_price) AS sales, {sql_mean("sold_price")} AS avg_price,
                {sql_total("sold_price")} AS volume, {sql_mean("days_on_market")} AS avg_dom
                FROM deals GROUP BY 1"""),
        ),
        "a08_mean_of_means": (
            _over("sold_date style sold_price", styles),
            sql(f""",
                t AS (SELECT {month} AS month, style, count(*) AS c,
                  CAST(sum(sold_price) AS DOUBLE) / count(sold_price) AS m FROM deals GROUP BY 1, 2)
                SELECT month, CAST(sum(c) AS BIGINT) AS deals, round(avg(m), 6) AS mean_of_means
                FROM t GROUP BY month"""),
        ),
        "a09_distinct_per_group": (
            _over(
                "community listing_agent",
                lambda d: d.groupBy("community").agg(
                    F.count_distinct("listing_agent").alias("agents")
                ),
            ),
            sql("SELECT community, count(DISTINCT listing_agent) AS agents FROM deals GROUP BY 1"),
        ),
        "a10_distinct_over_both_roles": (
            _over("listing_firm buyer_firm listing_agent buyer_agent", roles),
            sql("""SELECT firm, count(DISTINCT agent) AS agents FROM all_sides
                WHERE firm IS NOT NULL GROUP BY 1"""),
        ),
        "a11_distinct_firms": (
            _over("listing_firm", lambda d: d.agg(F.count_distinct("listing_firm").alias("firms"))),
            sql("SELECT count(DISTINCT listing_firm) AS firms FROM deals"),
        ),
        "a12_first_value_per_key": (
            _over(
                "listing_agent buyer_firm sold_date listing_id",
                lambda d: ranking.first_value_per_key(
                    d, "listing_agent", "buyer_firm", ranking.day_and_id("sold_date", "listing_id")
                ),
            ),
            sql("""SELECT listing_agent, buyer_firm FROM (
                SELECT listing_agent, buyer_firm, row_number() OVER (PARTITION BY listing_agent
                  ORDER BY sold_date, listing_id, buyer_firm) AS rn
                FROM deals WHERE buyer_firm IS NOT NULL) WHERE rn = 1"""),
        ),
        "a13_most_frequent": (
            _over(
                "community listing_firm",
                lambda d: ranking.most_frequent(d, "community", "listing_firm", "top_firm"),
            ),
            sql("""SELECT community, listing_firm AS top_firm FROM (
                SELECT community, listing_firm, row_number() OVER (PARTITION BY community
                  ORDER BY count(*) DESC, listing_firm) AS rn
                FROM deals GROUP BY 1, 2) WHERE rn = 1"""),
        ),
        "a14_half_credit": (
            _over(
                "listing_firm buyer_firm sold_price",
                lambda d: _sides(sides.with_dual(d), "sold_price", "is_dual")
                .dropna(subset=["firm"])
                .groupBy("firm")
                .agg(sides.half_credit(F.col("sold_price")).alias("sales")),
            ),
            sql(f"SELECT firm, {half} AS sales FROM all_sides WHERE firm IS NOT NULL GROUP BY 1"),
        ),
        "a15_mean_group_size": (
            _over(
                "listing_firm",
                lambda d: count_by(d, "listing_firm").agg(F.avg("deals").alias("avg_deals")),
            ),
            sql("""SELECT round(avg(c), 6) AS avg_deals
                FROM (SELECT count(*) AS c FROM deals GROUP BY listing_firm)"""),
        ),
        "a16_pivot_months": (
            _over("sold_date community", month_pivot),
            sql(f""",
                c AS (SELECT community, month, count(*) AS deals FROM f GROUP BY 1, 2)
                SELECT community, {pivot_cells} FROM c GROUP BY 1"""),
        ),
        "a17_pivot_month_by_year": (
            _over(
                "sold_date listing_firm buyer_firm days_on_market",
                lambda d: focus.seasonal_dom(d, three_years, "Supplier#000000002"),
            ),
            sql(f""",
                wide AS (SELECT month(sold_date) AS month_no, {year_cells} FROM deals
                  WHERE listing_firm = 'Supplier#000000002' OR buyer_firm = 'Supplier#000000002'
                  GROUP BY 1),
                calendar AS (SELECT * FROM (VALUES {calendar}) AS c(month_no, month))
                SELECT CAST(month_no AS INTEGER) AS month_no, month,
                  {", ".join(f"y{y}" for y in YEARS)} FROM calendar LEFT JOIN wide USING (month_no)"""),
        ),
        "a18_share_of_total": (
            _over("style", lambda d: grouping.with_share(count_by(d, "style"), "deals")),
            sql("""SELECT style, count(*) AS deals,
                round(count(*) / (SELECT count(*) FROM deals) * 100, 6) AS share_pct
                FROM deals GROUP BY 1"""),
        ),
        "a19_drop_duplicates": (
            _over(
                "sold_date buyer_firm",
                lambda d: with_month(d).select("buyer_firm", "month").dropDuplicates(
                    ["buyer_firm", "month"]
                ),
            ),
            sql(f"SELECT DISTINCT buyer_firm, {month} AS month FROM deals"),
        ),
        "a20_histogram_2d": (
            _over(
                "days_on_market sold_price",
                lambda d: grouping.histogram_2d(d, "days_on_market", "sold_price", 50, 50),
            ),
            sql(""",
                v AS (SELECT CAST(days_on_market AS DOUBLE) AS x, CAST(sold_price AS DOUBLE) AS y
                  FROM deals),
                b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
                SELECT CAST(least(floor(50 * (x - x0) / (x1 - x0)) + 1, 50) AS INTEGER)
                    AS days_on_market_bin,
                  CAST(least(floor(50 * (y - y0) / (y1 - y0)) + 1, 50) AS INTEGER) AS sold_price_bin,
                  count(*) AS deals FROM v, b GROUP BY 1, 2"""),
        ),
        "a21_histogram_by_year": (
            _over(
                "sold_date total_flr_area_sf",
                lambda d: grouping.histogram(
                    d.withColumn("year", F.year("sold_date")), "total_flr_area_sf", 20, "year"
                ),
            ),
            sql(""",
                b AS (SELECT min(total_flr_area_sf) AS x0, max(total_flr_area_sf) AS x1 FROM deals)
                SELECT CAST(least(floor(20 * (total_flr_area_sf - x0) / (x1 - x0)) + 1, 20) AS INTEGER)
                  AS total_flr_area_sf_bin, CAST(year(sold_date) AS INTEGER) AS year,
                  count(*) AS deals FROM deals, b GROUP BY 1, 2"""),
        ),
        "a22_frequency_by_year": (
            _over(
                "sold_date total_bedrooms",
                lambda d: count_by(d.withColumn("year", F.year("sold_date")), "total_bedrooms", "year"),
            ),
            sql("""SELECT total_bedrooms, CAST(year(sold_date) AS INTEGER) AS year,
                count(*) AS deals FROM deals GROUP BY 1, 2"""),
        ),
        "a23_against_market": (
            _over("listing_firm days_on_market", against_market),
            sql(f""",
                k AS (SELECT avg(days_on_market) FILTER (WHERE listing_firm = '{FOCUS}') AS mine,
                  avg(days_on_market) AS everyone FROM deals)
                SELECT round(mine, 6) AS focus_dom, round(everyone, 6) AS market_dom,
                  round(everyone - mine, 6) AS delta FROM k"""),
        ),
        "a24_deals_per_active_agent": (
            _over("listing_firm buyer_firm listing_agent buyer_agent", per_agent),
            sql("""SELECT firm, count(DISTINCT agent) AS agents,
                count(*) FILTER (WHERE is_listing OR NOT is_dual) AS deals,
                round(count(*) FILTER (WHERE is_listing OR NOT is_dual) / count(DISTINCT agent), 6)
                  AS deals_per_agent
                FROM all_sides WHERE firm IS NOT NULL GROUP BY 1"""),
        ),
        "a25_guarded_mean": (
            _over(
                "community year_built sold_price",
                lambda d: d.groupBy("community").agg(
                    ratio_or_zero(
                        total(F.when(F.col("year_built") > 2030, F.col("sold_price"))),
                        F.count_if(F.col("year_built") > 2030),
                    ).alias("avg_price_future"),
                    ratio_or_zero(total(F.col("sold_price")), F.count(F.lit(1))).alias("avg_price"),
                ),
            ),
            sql("""SELECT community, CAST(0 AS DOUBLE) AS avg_price_future,
                round(CAST(sum(sold_price) AS DOUBLE) / count(*), 6) AS avg_price
                FROM deals GROUP BY 1"""),
        ),
        "a26_zero_filled_bins": (
            _over(
                "listing_agent days_on_market",
                lambda d: grouping.zero_filled_bins(
                    d, "listing_agent", "days_on_market", DOM_EDGES, DOM_LABELS, "dom_range"
                ),
            ),
            sql(f""",
                bins AS (SELECT * FROM (VALUES {bins}) AS b(bin_no, dom_range)),
                c AS (SELECT listing_agent, {cut("days_on_market", DOM_EDGES, DOM_LABELS)} AS dom_range,
                  count(*) AS deals FROM deals GROUP BY 1, 2)
                SELECT listing_agent, CAST(bin_no AS INTEGER) AS bin_no, dom_range,
                  coalesce(deals, 0) AS deals
                FROM (SELECT DISTINCT listing_agent FROM deals) CROSS JOIN bins
                LEFT JOIN c USING (listing_agent, dom_range)"""),
        ),
    }


def ranking_entries() -> dict[str, Entry]:
    firms = "SELECT firm, count(*) AS deals FROM all_sides WHERE firm IS NOT NULL GROUP BY 1"

    def newest(d):
        order = (F.desc("sold_date"), F.desc("sold_price"), F.asc("listing_id"))
        return ranking.best_per_key(d, ["listing_agent"], order)

    def ranked(d):
        return ranking.dense_rank_counts(count_by(_sides(d), "firm"), "deals")

    def pinned(d):
        counts = count_by(_sides(d), "firm")
        return ranking.top_and_pinned(counts, "deals", "firm", 10, FOCUS).withColumn(
            "is_focus", brokers.is_focus("firm", FOCUS)
        )

    def shares(d):
        counts = count_by(d, "style")
        whole = counts.agg(F.sum("deals")).scalar()
        return counts.withColumn("share_pct", percent(F.col("deals"), whole)).orderBy(
            F.desc("share_pct"), "style"
        )

    return {
        "w01_dense_rank": (
            _over("listing_firm buyer_firm", ranked),
            sql(f"""SELECT firm, deals, CAST(dense_rank() OVER (ORDER BY deals DESC) AS INTEGER)
                AS ranking FROM ({firms})"""),
        ),
        "w02_rank_of_one": (
            _over("listing_agent buyer_agent", lambda d: agent.rank_of(d, AGENT)),
            sql(f"""SELECT agent, total_deals, ranking FROM (SELECT agent, total_deals,
                  CAST(dense_rank() OVER (ORDER BY total_deals DESC) AS INTEGER) AS ranking
                FROM (SELECT agent, count(*) AS total_deals FROM all_sides
                  WHERE agent IS NOT NULL GROUP BY 1)) WHERE agent = '{AGENT}'"""),
        ),
        "w03_best_per_key": (
            _over("listing_agent sold_date sold_price listing_id", newest),
            sql("""SELECT listing_agent, sold_date, sold_price, listing_id FROM (
                SELECT *, row_number() OVER (PARTITION BY listing_agent
                  ORDER BY sold_date DESC, sold_price DESC, listing_id) AS rn
                FROM deals) WHERE rn = 1"""),
        ),
        "l01_top_by_count": (
            _over("listing_agent", lambda d: ranking.top_n(count_by(d, "listing_agent"), "deals", "listing_agent")),
            sql("""SELECT listing_agent, count(*) AS deals FROM deals
                GROUP BY 1 ORDER BY deals DESC, listing_agent LIMIT 10"""),
        ),
        "l02_top_by_sum": (
            _over(
                "listing_agent sold_price",
                lambda d: ranking.top_n(
                    d.groupBy("listing_agent").agg(total(F.col("sold_price")).alias("volume")),
                    "volume", "listing_agent",
                ),
            ),
            sql(f"""SELECT listing_agent, {sql_total("sold_price")} AS volume FROM deals
                GROUP BY 1 ORDER BY volume DESC, listing_agent LIMIT 10"""),
        ),
        "l03_bottom_by_count": (
            _over(
                "listing_agent",
                lambda d: ranking.bottom_n(count_by(d, "listing_agent"), "deals", "listing_agent"),
            ),
            sql("""SELECT listing_agent, count(*) AS deals FROM deals
                GROUP BY 1 ORDER BY deals, listing_agent LIMIT 10"""),
        ),
        "l04_full_sort": (
            _over("style", shares),
            sql("""SELECT style, count(*) AS deals,
                round(count(*) / (SELECT count(*) FROM deals) * 100, 6) AS share_pct
                FROM deals GROUP BY 1"""),
        ),
        "l04_full_sort_order": (
            _over("style", lambda d: shown_order(grouping.value_counts(d, "style"))),
            sql("""SELECT style, deals, CAST(row_number() OVER (ORDER BY deals DESC, style) AS INTEGER) AS position
                FROM (SELECT style, count(*) AS deals FROM deals WHERE style IS NOT NULL GROUP BY 1)"""),
        ),
        "l05_top_and_pinned": (
            _over("listing_firm buyer_firm", pinned),
            sql(f""",
                c AS ({firms})
                SELECT firm, deals, firm = '{FOCUS}' AS is_focus FROM c WHERE firm = '{FOCUS}'
                  OR firm IN (SELECT firm FROM c ORDER BY deals DESC, firm LIMIT 10)"""),
        ),
        "l06_preview": (
            _over(
                "listing_id sold_date sold_price listing_agent",
                lambda d: preview(d, 5, ("sold_date", "listing_id", "sold_price")),
            ),
            sql("""SELECT listing_id, sold_date, sold_price, listing_agent FROM deals
                ORDER BY sold_date, listing_id, sold_price LIMIT 5"""),
        ),
        "u01_union_all_sides": (
            _over(
                "listing_firm buyer_firm listing_agent buyer_agent",
                lambda d: _sides(d, agent=True).groupBy("is_listing", "firm").agg(
                    F.count(F.lit(1)).alias("sides"), F.count("agent").alias("with_agent")
                ),
            ),
            sql("""SELECT is_listing, firm, count(*) AS sides, count(agent) AS with_agent
                FROM all_sides GROUP BY 1, 2"""),
        ),
        "u02_union_distinct": (
            _over(
                "listing_agent buyer_agent",
                lambda d: filters.options_union(d, "listing_agent", "buyer_agent", "agent"),
            ),
            sql("""SELECT listing_agent AS agent FROM deals UNION
                SELECT buyer_agent FROM deals WHERE buyer_agent IS NOT NULL"""),
        ),
    }


def entries() -> dict[str, Entry]:
    return {
        **filter_entries(),
        **join_entries(),
        **aggregate_entries(),
        **ranking_entries(),
    }
