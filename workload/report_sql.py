"""SQL checks of the report queries."""

from dealspan.functions.bins import AREA_EDGES, AREA_LABELS, DOM_EDGES, DOM_LABELS
from dealspan.functions.dates import MONTH_NAMES, months_between
from dealspan.plans.choices import BOUND_COLUMNS, CASCADES, OPTION_LISTS
from dealspan.plans.market import DETAIL_COLUMNS
from workload.reports import PROFILE_KEYS
from workload.sql_base import age, cut, mean, money, sql, title, total
from workload.views import AGENT, COLUMNS, END, FOCUS, START, YEARS

LOW = FOCUS.lower()
MONTHS = months_between(START, END)


def _firm_league(side: str) -> str:
    return sql(f"""
    SELECT firm, {title("firm")} AS office, deals, gross_sales,
      {money("gross_sales")} AS gross_sales_text, firm = '{LOW}' AS is_focus
    FROM (SELECT {side}_firm AS firm, count(*) AS deals, {total("sold_price")} AS gross_sales
      FROM n WHERE {side}_firm IS NOT NULL GROUP BY 1 ORDER BY deals DESC, firm LIMIT 10)""")


_STAFFED = """,
monthly AS (SELECT firm, month, CASE WHEN count(*) FILTER (WHERE is_listing) > 0
    AND count(*) FILTER (WHERE NOT is_listing) > 0 THEN count(*) END AS deals
  FROM n_sides WHERE firm IS NOT NULL GROUP BY 1, 2),
heads AS (SELECT trim(lower(broker)) AS firm, CAST(date_trunc('month', date) AS DATE) AS month,
    avg(value) AS avg_agents FROM brokerage
  WHERE date BETWEEN DATE '%s' AND DATE '%s' GROUP BY 1, 2),
staffed AS (SELECT firm, month, deals, avg_agents FROM monthly JOIN heads USING (firm, month))""" % (
    START,
    END,
)

_ACTIVE = (
    _STAFFED
    + """,
active AS (SELECT firm, month, count(DISTINCT agent) AS active_agents FROM n_sides
  WHERE firm IN (SELECT firm FROM staffed) GROUP BY 1, 2)"""
)

_FIRST_FIRM = """,
firms AS (SELECT agent, firm FROM (
  SELECT agent, firm, row_number() OVER (PARTITION BY agent
    ORDER BY is_listing, sold_date, listing_id, firm) AS rn
  FROM n_sides WHERE agent IS NOT NULL AND firm IS NOT NULL) WHERE rn = 1)"""


def _agent_league(counts: str) -> str:
    return sql(
        _FIRST_FIRM
        + f""",
    top AS (SELECT agent, deals FROM ({counts}) ORDER BY deals DESC, agent LIMIT 10)
    SELECT agent, {title("agent")} AS agent_label, deals,
      coalesce(firm, 'Unknown Firm') AS firm FROM top LEFT JOIN firms USING (agent)"""
    )


def _key_figures(where: str) -> str:
    return sql(f"""
        SELECT count(*) AS total_listings_sold, {total("sold_price")} AS total_sales_volume,
          {mean("days_on_market")} AS avg_dom, {mean("sold_price")} AS avg_sold_price,
          round(avg(CAST(sold_price AS DOUBLE) / total_flr_area_sf), 6) AS avg_price_per_sqft
        FROM f WHERE {where}""")


def _share(sides: str, deals: str, base: str, pin: str | None) -> str:
    market = (
        f"SELECT month, count(*) AS total_deals FROM {deals} GROUP BY 1"
        if base == "deals"
        else f"SELECT month, count(*) AS total_deals FROM {sides} WHERE firm IS NOT NULL GROUP BY 1"
    )
    extra = f" OR firm = '{pin}'" if pin else ""
    return sql(f""",
    fm AS (SELECT firm, month, count(*) AS deals FROM {sides} WHERE firm IS NOT NULL GROUP BY 1, 2),
    market AS ({market}),
    shares AS (SELECT firm, month, deals, total_deals,
      CAST(deals AS DOUBLE) / total_deals * 100 AS share_pct FROM fm JOIN market USING (month)),
    top AS (SELECT firm FROM shares GROUP BY firm
      ORDER BY round(sum(share_pct), 6) DESC, firm LIMIT 10)
    SELECT firm, month, deals, total_deals, round(share_pct, 6) AS share_pct FROM shares
    WHERE firm IN (SELECT firm FROM top){extra}""")


_COMMUNITIES = f""",
metrics AS (SELECT community, count(sold_price) AS number_of_sales,
    {mean("sold_price")} AS average_price, {total("sold_price")} AS total_volume,
    {mean("days_on_market")} AS average_dom,
    CAST(sum(sold_price) AS DOUBLE) / count(sold_price) AS exact_price,
    CAST(sum(days_on_market) AS DOUBLE) / count(days_on_market) AS exact_dom
  FROM f WHERE community IS NOT NULL GROUP BY 1),
winners AS (SELECT community, listing_firm AS top_selling_firm FROM (
  SELECT community, listing_firm, row_number() OVER (PARTITION BY community
    ORDER BY count(*) DESC, listing_firm) AS rn
  FROM f WHERE community IS NOT NULL AND listing_firm IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)"""


def _focus_agents(source: str, side: str, direction: str) -> str:
    return sql(f"""
    SELECT {side}_agent AS agent, count(listing_id) AS deals, {total("sold_price")} AS revenue
    FROM {source} WHERE {side}_agent IS NOT NULL
    GROUP BY 1 ORDER BY deals {direction}, agent LIMIT 10""")


def _by_year(column: str) -> str:
    return sql(
        f"SELECT {column}, year, count(*) AS deals FROM jan WHERE {column} IS NOT NULL GROUP BY 1, 2"
    )


def _community_ranges(column: str, edges, labels, name: str) -> str:
    bins = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels, 1))
    return sql(f""",
    bins AS (SELECT * FROM (VALUES {bins}) AS b(bin_no, {name})),
    counted AS (SELECT community, {cut(column, edges, labels)} AS {name}, count(*) AS deals
      FROM jan_top GROUP BY 1, 2)
    SELECT community, CAST(bin_no AS INTEGER) AS bin_no, {name}, coalesce(deals, 0) AS deals
    FROM (SELECT DISTINCT community FROM jan_top) CROSS JOIN bins
    LEFT JOIN counted USING (community, {name})""")


def _brokerages(side: str) -> str:
    return sql(f"""
    SELECT {side}_firm AS firm, count(*) AS deals, {side}_firm = '{FOCUS}' AS is_focus
    FROM f WHERE {side}_firm IS NOT NULL GROUP BY 1 ORDER BY deals DESC, firm LIMIT 10""")


def _option_lists() -> str:
    parts = [
        f"SELECT '{name}' AS option, CAST(NULL AS VARCHAR) AS parent, CAST({c} AS VARCHAR) AS value FROM deals WHERE {c} IS NOT NULL"
        for name, columns in OPTION_LISTS.items()
        for c in columns
    ]
    parts += [
        f"SELECT '{name}', CAST({a} AS VARCHAR), CAST({b} AS VARCHAR) FROM deals WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for name, (a, b) in CASCADES.items()
    ]
    union = "\nUNION ".join(parts)
    return sql(f"""SELECT option, parent, value, CAST(row_number() OVER (PARTITION BY option, parent ORDER BY value) AS INTEGER)
        AS position FROM ({union})""")


def _bounds() -> str:
    cells = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in BOUND_COLUMNS)
    return sql(f"SELECT {cells} FROM deals")


# Columns of the profiled tables with their type codes.
_PROFILED = {
    "region": {"r_regionkey": "N", "r_name": "S"},
    "nation": {"n_nationkey": "N", "n_name": "S", "n_regionkey": "N"},
    "customer": {
        "c_custkey": "N", "c_name": "S", "c_nationkey": "N", "c_acctbal": "N", "c_mktsegment": "S",
    },
    "supplier": {"s_suppkey": "N", "s_name": "S", "s_nationkey": "N", "s_acctbal": "N"},
    "part": {
        "p_partkey": "N", "p_name": "S", "p_brand": "S", "p_type": "S", "p_size": "N",
        "p_retailprice": "N",
    },
    "orders": {
        "o_orderkey": "N", "o_custkey": "N", "o_orderstatus": "S", "o_totalprice": "N",
        "o_orderdate": "S", "o_orderpriority": "S",
    },
    "lineitem": {
        "l_orderkey": "N", "l_partkey": "N", "l_suppkey": "N", "l_linenumber": "N",
        "l_quantity": "N", "l_extendedprice": "N", "l_discount": "N", "l_tax": "N",
        "l_returnflag": "S", "l_linestatus": "S", "l_shipdate": "S",
    },
    "events": {
        "event_id": "N", "ts": "S", "user_id": "N", "event_type": "S", "value": "N", "props": "S",
    },
}


def schema_profile(tables) -> str:
    parts = []
    for table in tables:
        for column, code in _PROFILED[table].items():
            is_key = column in PROFILE_KEYS[table]
            parts.append(
                f"SELECT '{table}' AS table_name, '{column}' AS attribute, '{code}' AS type, {is_key} AS is_key, "
                f"count({column}) AS n_values FROM {table}" + ("" if is_key else f" HAVING count({column}) > 0")
            )
    return "\nUNION ALL ".join(parts)


def checks() -> dict[str, str]:
    monthly_cells = ", ".join(
        f"CAST(coalesce(sum(active_agents) FILTER (WHERE month = DATE '{m}'), 0) AS BIGINT) "
        f'AS "{m:%b-%Y}"'
        for m in MONTHS
    )
    calendar = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTH_NAMES, 1))
    year_cells = ", ".join(
        f"{mean('days_on_market', f'year(sold_date) = {y}')} AS y{y}" for y in YEARS
    )
    year_names = ", ".join(f"y{y}" for y in YEARS)
    focus_means = {
        "focus_dom": f"CAST(sum(days_on_market) FILTER (WHERE mine) AS DOUBLE) "
        "/ nullif(count(days_on_market) FILTER (WHERE mine), 0)",
        "market_dom": "CAST(sum(days_on_market) AS DOUBLE) / nullif(count(days_on_market), 0)",
        "focus_ratio": "sum(sold_list_ratio) FILTER (WHERE mine) "
        "/ nullif(count(sold_list_ratio) FILTER (WHERE mine), 0)",
        "market_ratio": "sum(sold_list_ratio) / nullif(count(sold_list_ratio), 0)",
    }
    return {
        "r01_top_listing_firms": _firm_league("listing"),
        "r02_top_buyer_firms": _firm_league("buyer"),
        "r03_top_combined_firms": sql(f"""
            SELECT firm, {title("firm")} AS office, deals, gross_sales,
              {money("gross_sales")} AS gross_sales_text, firm = '{LOW}' AS is_focus
            FROM (SELECT firm, count(*) AS deals,
                CAST(coalesce(sum(CASE WHEN NOT is_dual THEN CAST(sold_price AS DECIMAL(20,5))
                  WHEN is_listing THEN CAST(sold_price * 0.5 AS DECIMAL(20,5)) ELSE 0 END), 0)
                  AS DECIMAL(30,5)) AS gross_sales
              FROM n_sides WHERE firm IS NOT NULL GROUP BY 1
              HAVING count(*) FILTER (WHERE is_listing) > 0
                AND count(*) FILTER (WHERE NOT is_listing) > 0
              ORDER BY deals DESC, firm LIMIT 10)"""),
        "r04_average_headcount": sql(
            _STAFFED + "\nSELECT firm, month, round(avg_agents, 6) AS avg_agents FROM heads"
        ),
        "r05_deals_per_agent": sql(
            _STAFFED
            + f""",
            totals AS (SELECT firm, coalesce(sum(deals), 0) AS total FROM staffed GROUP BY 1),
            chosen AS (SELECT firm FROM totals WHERE firm = '{LOW}' OR firm IN
              (SELECT firm FROM totals ORDER BY total DESC, firm LIMIT 10)),
            months AS (SELECT CAST(generate_series AS DATE) AS month FROM
              generate_series(DATE '{MONTHS[0]}', DATE '{MONTHS[-1]}', INTERVAL 1 MONTH))
            SELECT firm, month, coalesce(deals, 0) AS deals,
              round(coalesce(avg_agents, 0), 6) AS avg_agents,
              round(coalesce(deals / nullif(avg_agents, 0), 0), 6) AS deals_per_agent
            FROM chosen CROSS JOIN months LEFT JOIN staffed USING (firm, month)"""
        ),
        "r06_market_share_top_firms": _share("n_sides", "n", "deals", None),
        "r07_active_agents_table": sql(
            _ACTIVE + f"\nSELECT firm, {monthly_cells} FROM active GROUP BY firm"
        ),
        "r07_active_agents_long": sql(
            _ACTIVE
            + "\nSELECT firm, month, active_agents, strftime(month, '%b-%Y') AS month_label FROM active"
        ),
        "r08_agent_firms": sql(_FIRST_FIRM + "\nSELECT agent, firm FROM firms"),
        "r09_top_listing_agents": _agent_league(
            "SELECT listing_agent AS agent, count(*) AS deals FROM n "
            "WHERE listing_agent IS NOT NULL GROUP BY 1"
        ),
        "r10_top_buyer_agents": _agent_league(
            "SELECT buyer_agent AS agent, count(*) AS deals FROM n "
            "WHERE buyer_agent IS NOT NULL GROUP BY 1"
        ),
        "r11_top_combined_agents": _agent_league(
            "SELECT agent, count(*) AS deals FROM n_sides WHERE agent IS NOT NULL GROUP BY 1 "
            "HAVING count(*) FILTER (WHERE is_listing) > 0 "
            "AND count(*) FILTER (WHERE NOT is_listing) > 0"
        ),
        "r12_market_key_figures": _key_figures("TRUE"),
        "r12_market_key_figures_filtered": _key_figures(
            "days_on_market BETWEEN 0 AND 1000 AND total_bedrooms BETWEEN 1 AND 5"
        ),
        "r13_price_trend": sql(f"""
            SELECT month, {mean("list_price")} AS avg_list_price,
              {mean("sold_price")} AS avg_sold_price FROM f GROUP BY month"""),
        "r14_style_trend": sql(f"""
            SELECT month, style, {total("sold_price")} AS total_gross_sales,
              count(sold_price) AS total_sales, {mean("sold_price")} AS avg_sales_price
            FROM f WHERE style IS NOT NULL GROUP BY month, style"""),
        "r15_style_totals": sql(""",
            t AS (SELECT month, style, sum(sold_price) AS s, count(sold_price) AS c,
              CAST(sum(sold_price) AS DOUBLE) / count(sold_price) AS m
              FROM f WHERE style IS NOT NULL GROUP BY month, style)
            SELECT month, CAST(sum(s) AS DECIMAL(38,4)) AS total_gross_sales,
              CAST(sum(c) AS BIGINT) AS total_sales, round(avg(m), 6) AS avg_sales_price
            FROM t GROUP BY month"""),
        "r16_dom_price_heatmap": sql(""",
            v AS (SELECT CAST(days_on_market AS DOUBLE) AS x, CAST(sold_price AS DOUBLE) AS y FROM f
              WHERE days_on_market IS NOT NULL AND sold_price IS NOT NULL),
            b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
            SELECT CAST(least(floor(50 * (x - x0) / (x1 - x0)) + 1, 50) AS INTEGER)
                AS days_on_market_bin,
              CAST(least(floor(50 * (y - y0) / (y1 - y0)) + 1, 50) AS INTEGER) AS sold_price_bin,
              count(*) AS deals FROM v, b GROUP BY 1, 2"""),
        "r17_community_metrics": sql(
            _COMMUNITIES
            + f"""
            SELECT community, number_of_sales, average_price, total_volume, average_dom,
              top_selling_firm, {money("exact_price")} AS average_price_text,
              {money("total_volume")} AS total_volume_text,
              format('{{:.1f}} days', exact_dom) AS average_dom_text
            FROM metrics LEFT JOIN winners USING (community)"""
        ),
        "r18_busiest_communities": sql(
            _COMMUNITIES
            + """
            SELECT community, number_of_sales, average_price, total_volume, average_dom,
              top_selling_firm FROM metrics LEFT JOIN winners USING (community)
            ORDER BY number_of_sales DESC, community LIMIT 20"""
        ),
        "r18_busiest_order": sql(
            _COMMUNITIES
            + """
            SELECT CAST(row_number() OVER (ORDER BY average_dom, community) AS INTEGER) AS position, community, number_of_sales
            FROM (SELECT * FROM metrics ORDER BY number_of_sales DESC, community LIMIT 20)"""
        ),
        "r17_community_order": sql(
            _COMMUNITIES
            + """
            SELECT CAST(row_number() OVER (ORDER BY number_of_sales DESC, community) AS INTEGER) AS position,
              community, number_of_sales FROM metrics"""
        ),
        "r19_transactions": sql(f"SELECT {', '.join(DETAIL_COLUMNS)} FROM f"),
        "r19_transactions_raw": sql(
            "SELECT * REPLACE (round(sold_list_ratio, 6) AS sold_list_ratio, "
            "round(total_flr_area_sf, 6) AS total_flr_area_sf) "
            f"FROM (SELECT {', '.join(COLUMNS)} FROM f)"
        ),
        "r20_focus_key_figures": sql(f""",
            m AS (SELECT *, coalesce(listing_firm = '{FOCUS}', FALSE)
              OR coalesce(buyer_firm = '{FOCUS}', FALSE) AS mine FROM f),
            k AS (SELECT count(*) FILTER (WHERE mine) AS focus_deals,
              CAST(coalesce(sum(sold_price) FILTER (WHERE mine), 0) AS DECIMAL(28,4)) AS focus_volume,
              {", ".join(f"{v} AS {n}" for n, v in focus_means.items())} FROM m)
            SELECT focus_deals, focus_volume, round(focus_dom, 6) AS focus_dom,
              round(market_dom, 6) AS market_dom, round(focus_ratio, 6) AS focus_ratio,
              round(market_ratio, 6) AS market_ratio, round(market_dom - focus_dom, 6) AS dom_delta,
              round(focus_ratio - market_ratio, 6) AS ratio_delta FROM k"""),
        "r21_focus_share_of_deals": sql("""
            SELECT 'Focus' AS party, count(*) AS deals,
              round(count(*) / nullif((SELECT count(*) FROM f), 0) * 100, 6) AS share_pct FROM mine
            UNION ALL
            SELECT 'Competitors', (SELECT count(*) FROM f) - count(*),
              round(((SELECT count(*) FROM f) - count(*)) / nullif((SELECT count(*) FROM f), 0) * 100, 6)
            FROM mine"""),
        "r22_focus_property_classes": sql(
            "SELECT property_class, count(*) AS deals FROM mine "
            "WHERE property_class IS NOT NULL GROUP BY 1"
        ),
        "r23_focus_communities_by_volume": sql(
            f"SELECT community, {total('sold_price')} AS volume FROM mine "
            "WHERE community IS NOT NULL GROUP BY 1 ORDER BY volume DESC, community LIMIT 10"
        ),
        "r24_focus_communities_by_count": sql(
            "SELECT community, count(*) AS deals FROM mine "
            "WHERE community IS NOT NULL GROUP BY 1 ORDER BY deals DESC, community LIMIT 10"
        ),
        "r25_focus_monthly_trend": sql(
            f"SELECT month, count(listing_id) AS deals, {mean('days_on_market')} AS avg_dom "
            "FROM mine GROUP BY month"
        ),
        "r26_focus_seasonal_dom": sql(f""",
            wide AS (SELECT month(sold_date) AS month_no, {year_cells} FROM deals
              WHERE sold_date BETWEEN DATE '{YEARS[0]}-01-01' AND DATE '{YEARS[-1]}-12-31'
                AND (listing_firm = '{FOCUS}' OR buyer_firm = '{FOCUS}') GROUP BY 1),
            calendar AS (SELECT * FROM (VALUES {calendar}) AS c(month_no, month))
            SELECT CAST(month_no AS INTEGER) AS month_no, month, {year_names}
            FROM calendar LEFT JOIN wide USING (month_no)"""),
        "r27_focus_role_shares": sql(f""",
            k AS (SELECT count(*) FILTER (WHERE listing_firm = '{FOCUS}') AS l,
              count(*) FILTER (WHERE buyer_firm = '{FOCUS}') AS b FROM mine)
            SELECT 'Listing Firm' AS role, l AS deals,
              round(l / nullif(l + b, 0) * 100, 6) AS share_pct FROM k
            UNION ALL SELECT 'Buyer Firm', b, round(b / nullif(l + b, 0) * 100, 6) FROM k"""),
        "r28_competitor_roles": sql(f""",
            top AS (SELECT listing_firm, count(*) AS deals FROM f
              WHERE listing_firm IS NOT NULL AND listing_firm <> '{FOCUS}'
              GROUP BY 1 ORDER BY deals DESC, listing_firm LIMIT 10),
            bought AS (SELECT buyer_firm, count(*) AS deals FROM f
              WHERE listing_firm IN (SELECT listing_firm FROM top)
                AND buyer_firm IN (SELECT listing_firm FROM top) GROUP BY 1),
            k AS (SELECT 'Listing Firm' AS role, avg(deals) AS avg_deals FROM top
              UNION ALL SELECT 'Buyer Firm', avg(deals) FROM bought)
            SELECT role, round(avg_deals, 6) AS avg_deals,
              round(avg_deals / (SELECT sum(avg_deals) FROM k) * 100, 6) AS share_pct FROM k"""),
        "r29_focus_agent_activity": sql(f""",
            k AS (SELECT count(DISTINCT agent) AS active_agents,
              (SELECT count(*) FROM mine) AS closed_deals
              FROM mine_sides WHERE firm = '{FOCUS}')
            SELECT active_agents, closed_deals,
              round(closed_deals / nullif(active_agents, 0), 6) AS deals_per_agent FROM k"""),
        "r30_focus_top_listing_agents": _focus_agents("mine", "listing", "DESC"),
        "r31_focus_top_buyer_agents": _focus_agents("mine", "buyer", "DESC"),
        "r32_focus_bottom_listing_agents": _focus_agents(
            f"(SELECT * FROM mine WHERE listing_firm = '{FOCUS}')", "listing", "ASC"
        ),
        "r33_focus_bottom_buyer_agents": _focus_agents(
            f"(SELECT * FROM mine WHERE buyer_firm = '{FOCUS}')", "buyer", "ASC"
        ),
        "r34_agent_ranking": sql("""
            SELECT agent, total_deals,
              CAST(dense_rank() OVER (ORDER BY total_deals DESC) AS INTEGER) AS ranking
            FROM (SELECT agent, count(*) AS total_deals FROM all_sides
              WHERE agent IS NOT NULL GROUP BY 1)"""),
        "r35_agent_key_figures": sql(f"""
            SELECT count(*) AS total_deals, {total("sold_price")} AS gross_sales,
              round(coalesce(CAST(sum(sold_price) AS DOUBLE) / nullif(count(*), 0), 0), 6)
                AS avg_price_per_deal FROM agent_f"""),
        "r36_agent_firms_text": sql(f"""
            SELECT coalesce(string_agg(firm, ', ' ORDER BY firm), '') AS firms FROM
              (SELECT DISTINCT firm FROM f_sides WHERE agent = '{AGENT}' AND firm IS NOT NULL)"""),
        "r37_agent_monthly_deals": sql("SELECT month, count(*) AS deals FROM agent_f GROUP BY month"),
        "r38_agent_communities": sql(
            "SELECT community, area_city, count(*) AS deals FROM agent_f "
            "WHERE community IS NOT NULL AND area_city IS NOT NULL GROUP BY 1, 2"
        ),
        "r39_january_sales": sql("SELECT year, count(*) AS properties_sold FROM jan GROUP BY year"),
        "r40_january_prices": sql(
            f"SELECT year, {mean('sold_price')} AS avg_sold_price, "
            f"{mean('list_price')} AS avg_list_price FROM jan GROUP BY year"
        ),
        "r41_january_bedrooms": _by_year("total_bedrooms"),
        "r42_january_area_histogram": sql(""",
            v AS (SELECT total_flr_area_sf AS x, year FROM jan WHERE total_flr_area_sf IS NOT NULL),
            b AS (SELECT min(x) AS x0, max(x) AS x1 FROM v)
            SELECT CAST(least(floor(20 * (x - x0) / (x1 - x0)) + 1, 20) AS INTEGER)
                AS total_flr_area_sf_bin, year, count(*) AS deals FROM v, b GROUP BY 1, 2"""),
        "r43_january_class_share": sql("""
            SELECT property_class, count(*) AS deals, round(count(*) /
              (SELECT count(*) FROM jan WHERE property_class IS NOT NULL) * 100, 6) AS share_pct
            FROM jan WHERE property_class IS NOT NULL GROUP BY 1"""),
        "r44_january_classes": _by_year("property_class"),
        "r45_january_styles": _by_year("style"),
        "r46_january_ages": sql(
            f"SELECT year, {age()} AS age_category, count(*) AS deals FROM jan GROUP BY 1, 2"
        ),
        "r47_community_ages": sql(
            f"SELECT community, {age()} AS age_category, count(*) AS deals FROM jan_top GROUP BY 1, 2"
        ),
        "r48_community_bedrooms": sql(
            "SELECT community, total_bedrooms, count(*) AS deals FROM jan_top "
            "WHERE total_bedrooms IS NOT NULL GROUP BY 1, 2"
        ),
        "r49_community_baths": sql(
            "SELECT community, total_baths, count(*) AS deals FROM jan_top "
            "WHERE total_baths IS NOT NULL GROUP BY 1, 2"
        ),
        "r50_community_area_ranges": _community_ranges(
            "total_flr_area_sf", AREA_EDGES, AREA_LABELS, "size_range"
        ),
        "r51_community_dom_ranges": _community_ranges(
            "days_on_market", DOM_EDGES, DOM_LABELS, "dom_range"
        ),
        "r52_period_totals": sql(
            "SELECT count(*) AS total_deals, count(DISTINCT listing_firm) AS total_brokerages FROM f"
        ),
        "r53_market_share_pinned": _share("f_sides", "f", "deals", FOCUS),
        "r53_market_share_by_sides": _share("f_sides", "f", "sides", FOCUS),
        "r54_top_brokerages_any_side": sql(f"""
            SELECT firm, count(*) FILTER (WHERE is_listing) AS listing_deals,
              count(*) FILTER (WHERE NOT is_listing) AS buyer_deals, count(*) AS total_deals,
              firm = '{FOCUS}' AS is_focus
            FROM f_sides WHERE firm IS NOT NULL GROUP BY firm
            ORDER BY total_deals DESC, firm LIMIT 10"""),
        "r55_top_brokerages_listing": _brokerages("listing"),
        "r56_top_brokerages_buyer": _brokerages("buyer"),
        "r57_option_lists": _option_lists(),
        "r57_bounds": _bounds(),
        "r58_schema_profile": schema_profile(PROFILE_KEYS),
    }
