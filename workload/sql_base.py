"""Shared SQL of the checks: the two logical tables and the row sets the reports start from."""

from workload.views import AGENT, END, FOCUS, START, YEARS

WHEN = f"sold_date BETWEEN DATE '{START}' AND DATE '{END}'"
MONTH = "CAST(date_trunc('month', sold_date) AS DATE)"

# ``|| ''``, MATERIALIZED and OFFSET 0 change no row. They keep dictionary-coded text and pushed
# filters out of the joins, where DuckDB 2.0.0 fails with an internal "dict-surviving cache" error.
_DEALS = """
deals AS MATERIALIZED (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS listing_id,
    CAST(l_shipdate AS DATE) AS sold_date,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(18,4)) AS sold_price,
    CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(18,4)) AS DOUBLE)
      / CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) * 100 AS sold_list_ratio,
    p_size * 100 + l_quantity AS total_flr_area_sf,
    CAST(p_size % 6 AS INTEGER) AS total_bedrooms,
    CAST(l_linenumber % 4 AS INTEGER) AS total_baths,
    CAST(CASE WHEN p_size % 13 <> 0 THEN year(o_orderdate) - p_size % 12 END AS INTEGER)
      AS year_built,
    CAST((l_orderkey * 7 + l_partkey) % 1101 AS INTEGER) AS days_on_market,
    p_type || '' AS property_class, p_brand || '' AS style, c_mktsegment || '' AS building_type,
    r_name || '' AS area_city, n_name || '' AS community, ls.s_name || '' AS listing_firm,
    CASE WHEN l_quantity <> 50 THEN bs.s_name || '' END AS buyer_firm,
    'agent-' || CAST(l_suppkey * 10 + l_partkey % 10 AS VARCHAR) AS listing_agent,
    CASE WHEN l_quantity <> 50
      THEN 'agent-' || CAST(buyer_suppkey * 10 + l_partkey % 7 AS VARCHAR) END AS buyer_agent
  FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS buyer_suppkey
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  JOIN part ON p_partkey = l_partkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN supplier ls ON ls.s_suppkey = l_suppkey
  JOIN supplier bs ON bs.s_suppkey =
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_suppkey ELSE buyer_suppkey END
  OFFSET 0
)"""

_BROKERAGE = """
brokerage AS MATERIALIZED (
  SELECT s_name || '' AS broker, m.date,
    CAST((s_suppkey + month(m.date)) % 20 AS DOUBLE) AS value
  FROM supplier CROSS JOIN
    (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem) m
  WHERE s_suppkey % 10 <> 3
)"""


def _sides(source: str) -> str:
    shared = (
        "sold_date, listing_id, sold_price, area_city, community, "
        f"{MONTH} AS month, coalesce(listing_firm = buyer_firm, FALSE) AS is_dual"
    )
    return (
        f"(SELECT TRUE AS is_listing, listing_firm AS firm, listing_agent AS agent, {shared} "
        f"FROM {source} UNION ALL "
        f"SELECT FALSE, buyer_firm, buyer_agent, {shared} FROM {source})"
    )


_YEARS = ", ".join(str(y) for y in YEARS)

PRELUDE = f"""WITH {_DEALS},
{_BROKERAGE},
f AS (SELECT *, {MONTH} AS month FROM deals WHERE {WHEN}),
n AS (SELECT * REPLACE (trim(lower(listing_firm)) AS listing_firm,
  trim(lower(buyer_firm)) AS buyer_firm) FROM f),
all_sides AS {_sides("deals")},
f_sides AS {_sides("f")},
n_sides AS {_sides("n")},
mine AS (SELECT * FROM f WHERE listing_firm = '{FOCUS}' OR buyer_firm = '{FOCUS}'),
mine_sides AS {_sides("mine")},
agent_f AS (SELECT * FROM f WHERE listing_agent = '{AGENT}' OR buyer_agent = '{AGENT}'),
jan AS (SELECT *, CAST(year(sold_date) AS INTEGER) AS year FROM deals
  WHERE month(sold_date) = 1 AND year(sold_date) IN ({_YEARS})
    AND area_city IS NOT NULL AND community IS NOT NULL),
jan_top AS (SELECT * FROM jan WHERE community IN
  (SELECT community FROM jan GROUP BY community ORDER BY count(*) DESC, community LIMIT 10))"""


def mean(c: str, where: str = "") -> str:
    flt = f" FILTER (WHERE {where})" if where else ""
    return f"round(CAST(sum({c}){flt} AS DOUBLE) / nullif(count({c}){flt}, 0), 6)"


def total(c: str, to: str = "DECIMAL(28,4)") -> str:
    return f"CAST(coalesce(sum({c}), 0) AS {to})"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: "
        f"CASE WHEN i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), '\\p{{L}}') "
        f"THEN upper(substr({c}, i, 1)) ELSE lower(substr({c}, i, 1)) END), '')"
    )


def money(c: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST(round({c}, 2) AS DOUBLE))"


def cut(c: str, edges, labels) -> str:
    whens = " ".join(
        f"WHEN {c} >= {lo} AND {c} < {hi} THEN '{label}'"
        for lo, hi, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {whens} END"


def age(sold: str = "sold_date", built: str = "year_built") -> str:
    years = f"(year({sold}) - {built})"
    return (
        f"CASE WHEN {years} IS NULL THEN 'Unknown' WHEN {years} <= 2 THEN '1-2 years' "
        f"WHEN {years} <= 5 THEN '3-5 years' ELSE '5+ years' END"
    )


def sql(body: str) -> str:
    """A check over the shared row sets; more CTEs may follow a leading comma."""
    body = body.strip()
    return PRELUDE + (body if body.startswith(",") else "\n" + body)
