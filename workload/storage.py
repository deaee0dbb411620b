"""Queries S1 to S17: scans, sinks and profiles. Each writes into the cluster's shared folder
where a round trip is the point, and reads the written table back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.functions.text import normalize_name
from dealspan.operators.filters import DealFilter
from dealspan.operators.grouping import count_by, with_month
from dealspan.plans import brokerage as brokerage_plans
from dealspan.plans import brokers
from dealspan.schema import DEALS, DISPLAY_NAMES
from dealspan.session import shared_dir
from dealspan.sources import ingest, profile, readers, sinks, versions
from workload import cleaning, views
from workload.reports import PROFILE_KEYS, WINDOW, Query, rounded
from workload.report_sql import checks, schema_profile
from workload.sql_base import sql
from workload.views import FOCUS, START

Entry = tuple[Query, str]

CUTOFF = date(1998, 7, 1)
ORDER = ("sold_date", "listing_id", "sold_price", "listing_agent")
LINE_COLUMNS = ("listing_id", "sold_date", "list_price", "sold_price", "listing_agent", "days_on_market")
EVENT_DOCUMENT = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new directory in the shared folder for each run."""
    return f"{shared_dir(spark)}/dealspan/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.deals(spark, sf_dir, *LINE_COLUMNS)


def _csv_scan(spark, sf):
    """Listings exported as CSV text, read under an explicit schema and cleaned."""
    path = scratch(spark, "listings-csv")
    names = ("listing_id", "sold_date", "list_price", "sold_price", "total_flr_area_sf",
             "total_bedrooms", "year_built", "community", "listing_firm", "buyer_firm")
    shown = cleaning.raw(spark, sf, *names).withColumnsRenamed({c: DISPLAY_NAMES[c] for c in names})
    sinks.export_csv(shown, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in shown.columns])
    cleaned = ingest.clean_deals(readers.read_csv(spark, path, schema))
    return rounded(
        cleaned.groupBy(normalize_name(F.col("buyer_firm")).alias("buyer_firm"), "community").agg(
            F.count(F.lit(1)).alias("deals"),
            F.count("year_built").alias("with_year"),
            F.sum("list_price").alias("list_total"),
            F.sum("sold_price").alias("sold_total"),
            F.sum("total_flr_area_sf").alias("area_total"),
            F.min("sold_date").alias("first_sold"),
            F.max("sold_date").alias("last_sold"),
            F.sum("total_bedrooms").alias("bedrooms"),
        )
    )


def _written_deals(spark, sf) -> str:
    path = scratch(spark, "deals")
    sinks.write_deals(_lines(spark, sf), path)
    return path


def _full_scan(spark, sf):
    found = readers.scan_table(spark, _written_deals(spark, sf))
    return found.groupBy(F.year("sold_date").alias("year")).agg(
        F.count(F.lit(1)).alias("deals"), F.sum("sold_price").alias("sold_total")
    )


def _dated_scan(spark, sf):
    found = readers.scan_table(spark, _written_deals(spark, sf), START, CUTOFF)
    return count_by(found, "sold_date")


def _documents(spark, sf):
    path = scratch(spark, "events-json")
    events = views.read(spark, sf, "events")
    events.select(F.col("event_id").cast("string").alias("_id"), "event_type", "value", "props").write.json(path)
    found = readers.scan_documents(spark, path, EVENT_DOCUMENT)
    return found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value_total"),
        F.lit(len(found.columns)).alias("fields"),
    )


def _alias(spark, sf):
    readers.register("listings", views.deals(spark, sf, "style", "sold_price"))
    return readers.table(spark, "real_estate_listings").groupBy("style").agg(
        F.count(F.lit(1)).alias("deals")
    )


def _renamed(spark, sf):
    shown = readers.to_display_names(views.deals(spark, sf, "style", "area_city", "sold_price"))
    return shown.groupBy("Style", "Area/City").agg(F.max("Sold Price").alias("Top Price"))


def _load_tables(spark, sf):
    tables = {
        "brokerage": views.brokerage(spark, sf),
        "real_estate_listings": views.deals(spark, sf, "listing_id"),
        "archive": views.deals(spark, sf, "sold_date").filter(F.col("sold_date") < F.lit(date(1900, 1, 1))),
    }
    kept = readers.load_tables(tables)
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in kept.items()
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


def _empty(spark, sf):
    never = DealFilter(start=date(1900, 1, 1), end=date(1900, 12, 31))
    deals = readers.with_columns_present(views.deals(spark, sf, "sold_date", "listing_firm"), DEALS)
    return brokerage_plans.top_brokerages(deals, never, FOCUS)


def _upsert(spark, sf):
    """Two loads under one key: a repeated key keeps the later load's latest row."""
    lines, latest = _lines(spark, sf), [F.desc(c) for c in ORDER + ("list_price", "days_on_market")]
    path = scratch(spark, "upsert")
    for part in (F.col("sold_date") < F.lit(CUTOFF), F.col("sold_date") >= F.lit(CUTOFF)):
        versions.upsert(lines.filter(part), path, ["listing_id"], latest)
    found = with_month(versions.read_upserted(spark, path))
    return found.groupBy("month").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("sold_price").alias("sold_total")
    )


def _append(spark, sf):
    path, heads = scratch(spark, "brokerage"), views.brokerage(spark, sf)
    sinks.append(heads.filter(F.col("date") < F.lit(CUTOFF)), path)
    sinks.append(heads.filter(F.col("date") >= F.lit(CUTOFF)), path)
    return spark.read.parquet(path).groupBy("broker").agg(
        F.count(F.lit(1)).alias("months"), F.sum("value").alias("headcount")
    )


def _batched_append(spark, sf):
    """Batches of 500 in one load, loaded twice: the second run replaces the first."""
    path = scratch(spark, "batches")
    batched = sinks.with_batches(_lines(spark, sf), ORDER, 500)
    valid = F.col("days_on_market") < 1000
    for _ in range(2):
        versions.commit_load(batched, path, "load-1", valid)
    kept = versions.read_loads(spark, path).withColumn("rejected", F.lit(False))
    lost = versions.read_loads(spark, path, rejected=True).withColumn("rejected", F.lit(True))
    return kept.unionByName(lost).groupBy("load_id", "batch_id", "rejected").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("sold_price").alias("sold_total")
    )


def _chunks(spark, sf):
    """Chunks of 25, written in parallel by as many tasks as there are partitions."""
    path = scratch(spark, "chunks")
    sinks.write_parallel(sinks.with_batches(_lines(spark, sf), ORDER, 25), path)
    sizes = count_by(spark.read.parquet(path), "batch_id")
    return sizes.groupBy(F.col("deals").alias("chunk_size")).agg(F.count(F.lit(1)).alias("chunks"))


def _sorted_lines(spark, sf) -> str:
    path = scratch(spark, "sorted")
    _lines(spark, sf).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.parquet(path)
    return path


def _file_chunks(spark, sf):
    """Chunks of 25 by the rows' places in the files of a sorted table."""
    numbered = sinks.with_file_row_number(spark, _sorted_lines(spark, sf))
    sizes = count_by(numbered.withColumn("batch_id", F.floor(F.col("row_index") / 25) + 1), "batch_id")
    return sizes.groupBy(F.col("deals").alias("chunk_size")).agg(F.count(F.lit(1)).alias("chunks"))


def _file_row_numbers(spark, sf):
    numbered = sinks.with_file_row_number(spark, _sorted_lines(spark, sf))
    return numbered.groupBy("sold_date").agg(
        F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row")
    )


def _item_schema(spark, sf):
    return profile.item_profile(views.read(spark, sf, "events"), "props")


def _uneven_items(spark, sf):
    """Events as items whose attributes come late, change type, are null or are broken off."""
    late = F.when(F.col("event_id") % 997 == 996, F.concat(F.lit(', "late": '), F.lower((F.col("user_id") % 2 == 0).cast("string"))))
    mixed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise(F.lit("null"))
    item = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "mixed": '), mixed, F.lit(', "nested": '), nested,
                    F.lit(', "never": null'), F.coalesce(late, F.lit("")), F.lit("}"))
    text = F.when(F.col("event_id") % 101 == 7, F.substring(item, 1, 20)).when(F.col("event_id") % 103 == 5, F.lit("[1, 2]"))
    text = text.when(F.col("event_id") % 107 == 3, F.lit(None)).when(F.col("event_id") % 109 == 3, F.lit("{}")).otherwise(item)
    return profile.item_profile(views.read(spark, sf, "events").select(text.alias("item")), "item")


def _catalog_schema(spark, sf):
    for name in ("customer", "events"):
        views.read(spark, sf, name).createOrReplaceTempView(f"dealspan_{name}")
    tables = {
        name.removeprefix("dealspan_"): df
        for name, df in profile.catalog_tables(spark, "dealspan_*").items()
    }
    return profile.profile_tables(tables, PROFILE_KEYS)


def _cached(spark, sf):
    """One cached narrow table feeds two reports."""
    path = scratch(spark, "cached")
    with sinks.cached(views.deals(spark, sf, "sold_date", "listing_firm", "buyer_firm")) as deals:
        found = [
            brokerage_plans.top_brokerages_by_side(deals, WINDOW, side, FOCUS).withColumn("side", F.lit(side))
            for side in ("listing", "buyer")
        ]
        both = found[0].unionByName(found[1])
        both.write.parquet(path)
    return spark.read.schema(both.schema).parquet(path)


def _csv_export(spark, sf):
    deals = views.deals(
        spark, sf, "sold_date", "listing_firm", "buyer_firm", "listing_agent", "buyer_agent"
    )
    table = brokers.active_agents_table(deals, views.brokerage(spark, sf), WINDOW)
    path = scratch(spark, "agents-csv")
    sinks.export_csv(table, path)
    return readers.read_csv(spark, path, table.schema)


def _row_numbers(spark, sf):
    numbered = sinks.with_row_number(_lines(spark, sf), ORDER)
    return numbered.groupBy("sold_date").agg(
        F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row")
    )


def _row_ids(spark, sf):
    ids = sinks.with_row_id(_lines(spark, sf))
    return ids.agg(F.count(F.lit(1)).alias("deals"), F.count_distinct("row_id").alias("ids"))


def _item_profile(source: str, column: str) -> str:
    kinds = "CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'BOOL' WHEN 'ARRAY' THEN 'L' WHEN 'OBJECT' THEN 'M' WHEN 'VARCHAR' THEN 'S' ELSE 'N' END"
    return f"""WITH t AS (SELECT {column} AS t, json_valid({column}) AND coalesce(json_type(try_cast({column} AS JSON)), '') = 'OBJECT' AS ok
        FROM {source} WHERE {column} IS NOT NULL),
      f AS (SELECT unnest(json_keys(t)) AS key, t FROM t WHERE ok),
      k AS (SELECT key, json_extract(t, '$."' || key || '"') AS v FROM f)
      SELECT key AS attribute, coalesce(string_agg(DISTINCT {kinds}, '|' ORDER BY {kinds}), 'NULL') AS type,
        count(*) AS n_items, count(*) FILTER (json_type(v) = 'NULL') AS n_nulls FROM k GROUP BY key
      UNION ALL SELECT NULL, 'INVALID', count(*), 0 FROM t WHERE NOT ok HAVING count(*) > 0"""


def entries() -> dict[str, Entry]:
    month = "CAST(date_trunc('month', sold_date) AS DATE)"
    order = ", ".join(ORDER)
    numbered = f""",
        r AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS row_index FROM deals)"""
    firms = """SELECT {side}_firm AS firm, count(*) AS deals, {side}_firm = '{focus}' AS is_focus,
        '{side}' AS side FROM f WHERE {side}_firm IS NOT NULL GROUP BY 1
        ORDER BY deals DESC, firm LIMIT 10"""

    return {
        "s01_csv_scan": (
            _csv_scan,
            sql("""SELECT lower(buyer_firm) AS buyer_firm, community, count(*) AS deals,
                count(year_built) AS with_year, CAST(sum(list_price) AS DECIMAL(28,2)) AS list_total,
                CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total,
                round(sum(total_flr_area_sf), 6) AS area_total, min(sold_date) AS first_sold,
                max(sold_date) AS last_sold, CAST(sum(total_bedrooms) AS BIGINT) AS bedrooms
                FROM deals GROUP BY 1, 2"""),
        ),
        "s02_full_scan": (
            _full_scan,
            sql("""SELECT CAST(year(sold_date) AS INTEGER) AS year, count(*) AS deals,
                CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total FROM deals GROUP BY 1"""),
        ),
        "s03_dated_scan": (
            _dated_scan,
            sql(f"""SELECT sold_date, count(*) AS deals FROM deals
                WHERE sold_date BETWEEN DATE '{START}' AND DATE '{CUTOFF}' GROUP BY 1"""),
        ),
        "s04_document_scan": (
            _documents,
            """SELECT event_type, count(*) AS events,
                CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value_total,
                CAST(3 AS INTEGER) AS fields FROM events GROUP BY 1""",
        ),
        "s05_table_alias": (_alias, sql("SELECT style, count(*) AS deals FROM deals GROUP BY 1")),
        "s06_renamed_columns": (
            _renamed,
            sql("""SELECT style AS "Style", area_city AS "Area/City", max(sold_price) AS "Top Price"
                FROM deals GROUP BY 1, 2"""),
        ),
        "s07_load_tables": (
            _load_tables,
            sql("""SELECT 'brokerage' AS table_name, count(*) AS row_count FROM brokerage
                UNION ALL SELECT 'real_estate_listings', count(*) FROM deals"""),
        ),
        "s08_empty_result": (
            _empty,
            """SELECT CAST(NULL AS VARCHAR) AS firm, CAST(0 AS BIGINT) AS listing_deals,
                CAST(0 AS BIGINT) AS buyer_deals, CAST(0 AS BIGINT) AS total_deals,
                FALSE AS is_focus WHERE FALSE""",
        ),
        "s09_keyed_upsert": (
            _upsert,
            sql(f""",
                r AS (SELECT *, row_number() OVER (PARTITION BY listing_id
                    ORDER BY sold_date >= DATE '{CUTOFF}' DESC, sold_date DESC, sold_price DESC,
                      listing_agent DESC, list_price DESC, days_on_market DESC) AS rn FROM deals)
                SELECT {month} AS month, count(*) AS deals,
                  CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total
                FROM r WHERE rn = 1 GROUP BY 1"""),
        ),
        "s10_append": (
            _append,
            sql("""SELECT broker, count(*) AS months, sum(value) AS headcount
                FROM brokerage GROUP BY 1"""),
        ),
        "s11_batched_append": (
            _batched_append,
            sql(f"""{numbered}
                SELECT 'load-1' AS load_id, CAST(floor(row_index / 500) + 1 AS BIGINT) AS batch_id,
                  days_on_market >= 1000 AS rejected, count(*) AS deals,
                  CAST(sum(sold_price) AS DECIMAL(28,4)) AS sold_total FROM r GROUP BY 1, 2, 3"""),
        ),
        "s12_parallel_chunks": (
            _chunks,
            sql("""SELECT chunk_size, count(*) AS chunks FROM (
                SELECT count(*) AS chunk_size FROM
                  (SELECT floor((row_number() OVER () - 1) / 25) AS chunk FROM deals)
                GROUP BY chunk) GROUP BY 1"""),
        ),
        "s12_file_chunks": (
            _file_chunks,
            sql("""SELECT chunk_size, count(*) AS chunks FROM (
                SELECT count(*) AS chunk_size FROM
                  (SELECT floor((row_number() OVER () - 1) / 25) AS chunk FROM deals)
                GROUP BY chunk) GROUP BY 1"""),
        ),
        "s13_item_schema": (
            _item_schema,
            _item_profile("events", "props"),
        ),
        "s13_uneven_items": (
            _uneven_items,
            _item_profile("""(SELECT CASE WHEN event_id % 101 = 7 THEN substr(item, 1, 20) WHEN event_id % 103 = 5 THEN '[1, 2]'
                WHEN event_id % 107 = 3 THEN NULL WHEN event_id % 109 = 3 THEN '{}' ELSE item END AS item
              FROM (SELECT event_id, '{"props": ' || props || ', "mixed": '
                || CASE WHEN event_id % 3 = 0 THEN '"' || event_type || '"' ELSE user_id::VARCHAR END || ', "nested": '
                || CASE WHEN event_id % 2 = 0 THEN '{"user": ' || user_id || '}' ELSE 'null' END || ', "never": null'
                || CASE WHEN event_id % 997 = 996 THEN ', "late": ' || (user_id % 2 = 0)::VARCHAR ELSE '' END || '}' AS item
                FROM events))""", "item"),
        ),
        "s14_catalog_schema": (_catalog_schema, schema_profile(("customer", "events"))),
        "s15_cached_table": (
            _cached,
            sql(
                f"SELECT * FROM ({firms.format(side='listing', focus=FOCUS)}) UNION ALL "
                f"SELECT * FROM ({firms.format(side='buyer', focus=FOCUS)})"
            ),
        ),
        "s16_csv_export": (_csv_export, checks()["r07_active_agents_table"]),
        "s17_row_number": (
            _row_numbers,
            sql(f"""{numbered} SELECT sold_date, min(row_index) AS first_row,
                max(row_index) AS last_row FROM r GROUP BY 1"""),
        ),
        "s17_file_row_number": (
            _file_row_numbers,
            sql(f"""{numbered} SELECT sold_date, min(row_index) AS first_row,
                max(row_index) AS last_row FROM r GROUP BY 1"""),
        ),
        "s17_row_id": (
            _row_ids,
            sql("SELECT count(*) AS deals, count(*) AS ids FROM deals"),
        ),
    }
