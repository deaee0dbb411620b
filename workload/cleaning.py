"""Queries C1 to C28: cleaning and scalar functions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspan.functions import bins, dates, numbers, text
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import count_by
from dealspan.plans import brokers, focus
from dealspan.schema import DEALS
from dealspan.sources import ingest, readers
from workload import views
from workload.reports import Query, rounded
from workload.sql_base import age, cut, money, sql, title
from workload.views import END, FOCUS, START

PRICE_RANGES = ("20000-60000", "oops")


def raw(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Deals as exported text; firm names in mixed case with outer blanks."""
    found = readers.to_canonical_names(ingest.export_text(views.deals(spark, sf_dir, *columns)))
    firms = [c for c in ("listing_firm", "buyer_firm") if c in columns]
    known = {c: F.when(F.col(c) != "N/A", F.col(c)) for c in firms}
    return found.withColumns(
        {
            c: F.coalesce(F.concat(F.lit("  "), F.upper(k), F.lit(" ")), F.lit("N/A"))
            for c, k in known.items()
        }
    )


def _over(columns: str, plan) -> Query:
    return lambda spark, sf: rounded(plan(views.deals(spark, sf, *columns.split())))


def _over_raw(columns: str, plan) -> Query:
    return lambda spark, sf: rounded(plan(raw(spark, sf, *columns.split())))


def _sum(df: DataFrame, key: str, value: str, to: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("deals"), F.sum(value).cast(to).alias("total")
    )


def _lenient(d: DataFrame) -> DataFrame:
    plain = F.col("sold_price").cast("string")
    mixed = F.when(F.col("total_baths") == 0, F.concat(F.lit("$"), plain)).otherwise(plain)
    return _sum(
        d.withColumn("n", numbers.lenient_number(mixed)), "total_baths", "n", "decimal(28,4)"
    )


def _safe(d: DataFrame) -> DataFrame:
    shown = F.concat(F.lit("$"), F.format_number("sold_price", 4))
    mixed = (
        F.when(F.col("total_baths") == 0, "abc")
        .when(F.col("total_baths") == 1, "")
        .when(F.col("total_baths") == 2, None)
        .otherwise(shown)
    )
    return _sum(d.withColumn("n", numbers.safe_decimal(mixed)), "total_baths", "n", "decimal(28,4)")


def _odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is NaN, infinite or finite by event type."""
    odd = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "click", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return views.read(spark, sf_dir, "events").select("event_type", odd.alias("value"))


def _nested_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    nested = _odd_values(spark, sf_dir).select(
        "event_type",
        F.struct(
            F.array(value, value).alias("list"), F.create_map(F.lit("v"), value).alias("map")
        ).alias("item"),
    )
    made = numbers.decimal_items(nested)
    return made.groupBy("event_type").agg(
        F.sum(F.col("item.list")[1]).cast("decimal(28,4)").alias("list_total"),
        F.sum(F.col("item.map")["v"]).cast("decimal(28,4)").alias("map_total"),
    )


def _finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = numbers.finite_columns(_odd_values(spark, sf_dir))
    return made.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("value").alias("known")
    )


def _items(d: DataFrame) -> DataFrame:
    made = ingest.listing_items(readers.with_columns_present(d, DEALS))
    return made.groupBy("property_class").agg(
        F.count(F.lit(1)).alias("deals"),
        F.count_if(F.col("buyer_firm") == "N/A").alias("without_buyer"),
        F.count_if(F.col("address") == "N/A").alias("without_address"),
        F.sum("sold_price").alias("sold_total"),
        F.sum("price_per_sqft").cast("decimal(28,4)").alias("per_area_total"),
        F.sum("year_built").cast("bigint").alias("year_total"),
    )


def _narrow_items(d: DataFrame) -> DataFrame:
    """Items of an export with four columns; the others get the defaults."""
    made = ingest.listing_items(d)
    return made.groupBy("community", "address", "status").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("sold_price").alias("sold_total"),
        F.sum("list_price").cast("decimal(28,4)").alias("list_total"), F.min("sold_date").alias("sold_date"),
    )


def _raw_headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headcounts as exported text; the broker is missing where the count is 0."""
    found = views.brokerage(spark, sf_dir)
    broker = F.when(F.col("value") == 0, F.when(F.month("date") % 2 == 0, "N/A")).otherwise(F.col("broker"))
    return found.select(
        broker.alias("Broker"), F.date_format("date", "M/d/yyyy").alias("Date"),
        F.when(F.col("value") == 1, "many").otherwise(F.col("value").cast("string")).alias("Value"),
    )


def _clean_headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.clean_brokerage(_raw_headcounts(spark, sf_dir)))


def _headcount_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _raw_headcounts(spark, sf_dir).withColumnsRenamed({"Broker": "broker", "Date": "date"})
    value = F.col("Value").try_cast("double")
    made = ingest.brokerage_items(named.select("broker", "date", F.when(value == 2, F.lit(float("inf"))).otherwise(value).alias("value")))
    return made.groupBy("broker").agg(
        F.count(F.lit(1)).alias("months"), F.count("value").alias("known"), F.sum("value").cast("decimal(28,4)").alias("headcount")
    )


def _dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("event.type"), F.col("user_id").alias("user.id")
    )
    return text.underscore_names(named).groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users")
    )


def _lenient_dates(d: DataFrame) -> DataFrame:
    known = F.col("sold_date")
    mixed = (
        F.when(F.col("total_baths") == 0, F.date_format(known, "yyyy-MM-dd"))
        .when(F.col("total_baths") == 1, F.lit("13/45/1998"))
        .otherwise(F.date_format(known, "M/d/yyyy"))
    )
    parsed = dates.lenient_date(mixed, dates.KNOWN_FORMATS)
    return d.select(parsed.alias("sold_date")).groupBy("sold_date").agg(F.count(F.lit(1)).alias("deals"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat_ws("/", "p_name", F.lower("p_type"), "p_brand")
    names = views.read(spark, sf_dir, "part").select(joined.alias("name"))
    both = names.unionByName(
        views.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    )
    return count_by(both.select(text.title_case(F.col("name")).alias("label")), "label", name="n")


def _price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = views.deals(spark, sf_dir, "sold_price")
    found = [
        DealFilter(price=text.range_param(shown))
        .apply(deals)
        .agg(F.lit(shown).alias("range_text"), F.count(F.lit(1)).alias("deals"))
        for shown in PRICE_RANGES
    ]
    return found[0].unionByName(found[1])


def _lists(d: DataFrame) -> DataFrame:
    pairs = d.dropna().distinct()
    return pairs.groupBy("community").agg(text.joined_distinct(F.col("style")).alias("styles"))


def _filled(d: DataFrame) -> DataFrame:
    listed = count_by(d.select(F.col("listing_agent").alias("agent")), "agent", name="listings")
    bought = count_by(d.select(F.col("buyer_agent").alias("agent")), "agent", name="purchases")
    return listed.join(bought, "agent", "left").fillna(0, ["purchases"])


def entries() -> dict[str, tuple[Query, str]]:
    return {
        "c01_parse_currency": (
            _over_raw(
                "listing_agent list_price",
                lambda d: _sum(
                    d.withColumn("n", numbers.parse_currency(F.col("list_price"))),
                    "listing_agent", "n", "decimal(28,2)",
                ),
            ),
            sql("""SELECT listing_agent, count(*) AS deals,
                CAST(sum(list_price) AS DECIMAL(28,2)) AS total FROM deals GROUP BY 1"""),
        ),
        "c02_parse_grouped_number": (
            _over_raw(
                "property_class total_flr_area_sf",
                lambda d: _sum(
                    d.withColumn("n", numbers.parse_grouped(F.col("total_flr_area_sf"))),
                    "property_class", "n", "double",
                ),
            ),
            sql("""SELECT property_class, count(*) AS deals,
                round(sum(total_flr_area_sf), 6) AS total FROM deals GROUP BY 1"""),
        ),
        "c03_lenient_number": (
            _over("total_baths sold_price", _lenient),
            sql("""SELECT total_baths, count(*) AS deals, CAST(sum(sold_price)
                FILTER (WHERE total_baths <> 0) AS DECIMAL(28,4)) AS total FROM deals GROUP BY 1"""),
        ),
        "c04_safe_decimal": (
            _over("total_baths sold_price", _safe),
            sql("""SELECT total_baths, count(*) AS deals, CAST(sum(CASE WHEN total_baths = 3
                THEN sold_price ELSE 0 END) AS DECIMAL(28,4)) AS total FROM deals GROUP BY 1"""),
        ),
        "c05_nested_floats_to_decimal": (
            _nested_decimals,
            """SELECT event_type, list_total, list_total AS map_total FROM (
                SELECT event_type, CAST(sum(CAST(value AS DECIMAL(28,4)))
                FILTER (WHERE event_type NOT IN ('error', 'click')) AS DECIMAL(28,4)) AS list_total
                FROM events GROUP BY 1)""",
        ),
        "c06_non_finite_to_null": (
            _finite,
            """SELECT event_type, count(*) AS events, count(value)
                FILTER (WHERE event_type NOT IN ('error', 'click')) AS known
                FROM events GROUP BY 1""",
        ),
        "c07_require_column": (
            lambda spark, sf: count_by(
                readers.require_column(views.brokerage(spark, sf), "broker"), "broker", name="months"
            ),
            sql("SELECT broker, count(*) AS months FROM brokerage GROUP BY 1"),
        ),
        "c08_drop_null_keys": (
            _over(
                "buyer_firm",
                lambda d: d.dropna(subset=["buyer_firm"]).groupBy("buyer_firm").agg(
                    F.count(F.lit(1)).alias("deals")
                ),
            ),
            sql("""SELECT buyer_firm, count(*) AS deals FROM deals
                WHERE buyer_firm IS NOT NULL GROUP BY 1"""),
        ),
        "c09_listing_items": (
            _over(" ".join(views.COLUMNS), _items),
            sql("""SELECT property_class, count(*) AS deals,
                count(*) FILTER (WHERE buyer_firm IS NULL) AS without_buyer,
                count(*) AS without_address, CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total,
                CAST(0 AS DECIMAL(28,4)) AS per_area_total,
                CAST(sum(coalesce(year_built, 0)) AS BIGINT) AS year_total
                FROM deals GROUP BY 1"""),
        ),
        "c09_narrow_export": (
            _over_raw("listing_id sold_price community", _narrow_items),
            sql("""SELECT community, 'N/A' AS address, 'N/A' AS status, count(*) AS deals,
                CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total, CAST(0 AS DECIMAL(28,4)) AS list_total,
                'N/A' AS sold_date FROM deals GROUP BY 1"""),
        ),
        "c08_clean_headcounts": (
            _clean_headcounts,
            sql("SELECT broker, date, CASE WHEN value <> 1 THEN value END AS value FROM brokerage WHERE value <> 0"),
        ),
        "c08_headcount_items": (
            _headcount_items,
            sql("""SELECT broker, count(*) AS months, count(*) FILTER (WHERE value > 2) AS known,
                CAST(sum(value) FILTER (WHERE value > 2) AS DECIMAL(28,4)) AS headcount
                FROM brokerage WHERE value <> 0 GROUP BY 1"""),
        ),
        "c10_underscore_names": (
            _dotted,
            "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
        ),
        "c11_normalize_names": (
            _over_raw(
                "listing_firm",
                lambda d: count_by(
                    d.select(text.normalize_name(F.col("listing_firm")).alias("firm")), "firm"
                ),
            ),
            sql("SELECT lower(listing_firm) AS firm, count(*) AS deals FROM deals GROUP BY 1"),
        ),
        "c12_strict_date": (
            _over_raw(
                "sold_date",
                lambda d: count_by(
                    d.select(dates.strict_date(F.col("sold_date")).alias("sold_date")), "sold_date"
                ),
            ),
            sql("SELECT sold_date, count(*) AS deals FROM deals GROUP BY 1"),
        ),
        "c13_lenient_date": (
            _over("sold_date total_baths", _lenient_dates),
            sql("""SELECT CASE WHEN total_baths <> 1 THEN sold_date END AS sold_date,
                count(*) AS deals FROM deals GROUP BY 1"""),
        ),
        "c14_day": (
            lambda spark, sf: count_by(
                views.read(spark, sf, "events").select(dates.day(F.col("ts")).alias("day")),
                "day", name="events",
            ),
            "SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1",
        ),
        "c15_month_bucket": (
            _over(
                "sold_date",
                lambda d: count_by(
                    d.select(dates.month_start(F.col("sold_date")).alias("month")), "month"
                ),
            ),
            sql("""SELECT CAST(date_trunc('month', sold_date) AS DATE) AS month, count(*) AS deals
                FROM deals GROUP BY 1"""),
        ),
        "c16_calendar_parts": (
            _over(
                "sold_date",
                lambda d: count_by(
                    d.select(
                        F.year("sold_date").alias("year"),
                        F.month("sold_date").alias("month_no"),
                        dates.month_name(F.col("sold_date")).alias("month"),
                    ),
                    "year", "month_no", "month",
                ),
            ),
            sql("""SELECT CAST(year(sold_date) AS INTEGER) AS year,
                CAST(month(sold_date) AS INTEGER) AS month_no, monthname(sold_date) AS month,
                count(*) AS deals FROM deals GROUP BY 1, 2, 3"""),
        ),
        "c17_title_case": (
            _titles,
            f"""SELECT {title("name")} AS label, count(*) AS n FROM (
                SELECT concat_ws('/', p_name, lower(p_type), p_brand) AS name FROM part
                UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1""",
        ),
        "c18_currency_text": (
            _over(
                "sold_price buyer_firm",
                lambda d: count_by(
                    d.select(
                        text.currency_text(
                            F.when(F.col("buyer_firm").isNotNull(), F.col("sold_price"))
                        ).alias("price_text")
                    ),
                    "price_text",
                ),
            ),
            sql(f"""SELECT CASE WHEN buyer_firm IS NULL THEN 'N/A' ELSE {money("sold_price")} END
                AS price_text, count(*) AS deals FROM deals GROUP BY 1"""),
        ),
        "c19_month_label": (
            _over(
                "sold_date",
                lambda d: count_by(
                    d.select(dates.month_label(F.col("sold_date")).alias("label")), "label"
                ),
            ),
            sql("SELECT strftime(sold_date, '%b-%Y') AS label, count(*) AS deals FROM deals GROUP BY 1"),
        ),
        "c20_focus_flag": (
            _over(
                "listing_firm",
                lambda d: count_by(
                    d.select(brokers.is_focus("listing_firm", FOCUS).alias("is_focus")), "is_focus"
                ),
            ),
            sql(f"""SELECT listing_firm = '{FOCUS}' AS is_focus, count(*) AS deals
                FROM deals GROUP BY 1"""),
        ),
        "c21_age_category": (
            _over(
                "style sold_date year_built",
                lambda d: count_by(
                    d.select(
                        "style",
                        bins.age_category(F.col("sold_date"), F.col("year_built")).alias("age"),
                    ),
                    "style", "age",
                ),
            ),
            sql(f"SELECT style, {age()} AS age, count(*) AS deals FROM deals GROUP BY 1, 2"),
        ),
        "c22_area_range": (
            _over(
                "total_flr_area_sf",
                lambda d: count_by(
                    d.select(bins.area_range(F.col("total_flr_area_sf")).alias("size_range")),
                    "size_range",
                ),
            ),
            sql(f"""SELECT * FROM (SELECT
                {cut("total_flr_area_sf", bins.AREA_EDGES, bins.AREA_LABELS)} AS size_range,
                count(*) AS deals FROM deals GROUP BY 1) WHERE size_range IS NOT NULL"""),
        ),
        "c23_dom_range": (
            _over(
                "days_on_market",
                lambda d: count_by(
                    d.select(bins.dom_range(F.col("days_on_market")).alias("dom_range")), "dom_range"
                ),
            ),
            sql(f"""SELECT * FROM (SELECT
                {cut("days_on_market", bins.DOM_EDGES, bins.DOM_LABELS)} AS dom_range,
                count(*) AS deals FROM deals GROUP BY 1) WHERE dom_range IS NOT NULL"""),
        ),
        "c24_joined_distinct": (
            _over("community style", _lists),
            sql("""SELECT community, string_agg(style, ', ' ORDER BY style) AS styles FROM
                (SELECT DISTINCT community, style FROM deals) GROUP BY 1"""),
        ),
        "c25_range_parameter": (
            _price_ranges,
            sql("""SELECT '20000-60000' AS range_text, count(*) AS deals FROM deals
                WHERE sold_price BETWEEN 20000 AND 60000
                UNION ALL SELECT 'oops', count(*) FROM deals WHERE sold_price >= 0"""),
        ),
        "c26_display_rounding": (
            lambda spark, sf: rounded(
                focus.key_figures_display(
                    focus.key_figures(
                        views.deals(
                            spark, sf, "sold_date", "listing_firm", "buyer_firm", "sold_price",
                            "days_on_market", "sold_list_ratio",
                        ),
                        DealFilter(start=START, end=END),
                        FOCUS,
                    )
                )
            ),
            sql(f""",
            k AS (SELECT (SELECT count(*) FROM mine) AS focus_deals,
                (SELECT CAST(sum(sold_price) AS DECIMAL(28,4)) FROM mine) AS focus_volume,
                (SELECT CAST(floor(avg(days_on_market)) AS INTEGER) FROM mine) AS focus_dom,
                (SELECT CAST(floor(avg(days_on_market)) AS INTEGER) FROM f) AS market_dom,
                (SELECT round_even(avg(sold_list_ratio), 1) FROM mine) AS focus_ratio,
                (SELECT round_even(avg(sold_list_ratio), 1) FROM f) AS market_ratio)
            SELECT *, market_dom - focus_dom AS dom_delta,
                round(focus_ratio - market_ratio, 1) AS ratio_delta FROM k"""),
        ),
        "c27_price_per_area": (
            _over(
                "style sold_price total_flr_area_sf",
                lambda d: d.groupBy("style").agg(
                    numbers.mean(
                        numbers.ratio(F.col("sold_price"), F.col("total_flr_area_sf"))
                    ).alias("price_per_area")
                ),
            ),
            sql("""SELECT style, round(avg(CAST(sold_price AS DOUBLE) / total_flr_area_sf), 6)
                AS price_per_area FROM deals GROUP BY 1"""),
        ),
        "c28_fill_missing_counts": (
            _over("listing_agent buyer_agent", _filled),
            sql("""SELECT l.agent, listings, coalesce(purchases, 0) AS purchases
                FROM (SELECT listing_agent AS agent, count(*) AS listings FROM deals GROUP BY 1) l
                LEFT JOIN (SELECT buyer_agent AS agent, count(*) AS purchases FROM deals
                  WHERE buyer_agent IS NOT NULL GROUP BY 1) b ON b.agent = l.agent"""),
        ),
    }
