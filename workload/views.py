"""The given tables seen as the two logical tables, ``deals`` and ``brokerage``.

``deals`` joins only the tables that the asked columns need. Dimension joins carry no
broadcast hint: Spark compares each side's size with its threshold and falls back to a
shuffled join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspan.functions.dates import month_start
from dealspan.functions.numbers import ratio

FOCUS = "Supplier#000000001"
START, END = date(1998, 1, 1), date(1998, 12, 31)
YEARS = (1997, 1998, 1999)
AGENT = "agent-0"

_PART = {"total_flr_area_sf", "total_bedrooms", "year_built", "property_class", "style"}
_BUYER = {"buyer_firm", "buyer_agent"}
_CUSTOMER = {"building_type", "area_city", "community"}
_NATION = {"area_city", "community"}
_ORDERS = _CUSTOMER | _BUYER | {"year_built"}

COLUMNS = (
    "listing_id", "sold_date", "list_price", "sold_price", "sold_list_ratio",
    "total_flr_area_sf", "total_bedrooms", "total_baths", "year_built", "days_on_market",
    "property_class", "style", "building_type", "area_city", "community",
    "listing_firm", "buyer_firm", "listing_agent", "buyer_agent",
)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under its declared schema, so no job looks at file footers first."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _column(name: str) -> Column:
    """Expression of one deals column over the joined tables."""
    return _EXPRESSIONS[name]().alias(name)


def _list_price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _sold_price() -> Column:
    discount = F.col("l_discount").cast("decimal(4,2)")
    return (_list_price() * (F.lit(1).cast("decimal(1,0)") - discount)).cast("decimal(18,4)")


def _agent(firm_key: str, modulus: int) -> Column:
    number = F.col(firm_key) * 10 + F.col("l_partkey") % modulus
    return F.concat(F.lit("agent-"), number.cast("string"))


def _with_buyer(c: Column) -> Column:
    return F.when(F.col("l_quantity") != 50, c)


_EXPRESSIONS: dict[str, Callable[[], Column]] = {
    "listing_id": lambda: (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"),
    "sold_date": lambda: F.col("l_shipdate").cast("date"),
    "list_price": _list_price,
    "sold_price": _sold_price,
    "sold_list_ratio": lambda: ratio(_sold_price(), _list_price()) * 100,
    "total_flr_area_sf": lambda: F.col("p_size") * 100 + F.col("l_quantity"),
    "total_bedrooms": lambda: F.col("p_size") % 6,
    "total_baths": lambda: F.col("l_linenumber") % 4,
    "year_built": lambda: F.when(
        F.col("p_size") % 13 != 0, F.year("o_orderdate") - F.col("p_size") % 12
    ),
    "days_on_market": lambda: ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 1101).cast("int"),
    "property_class": lambda: F.col("p_type"),
    "style": lambda: F.col("p_brand"),
    "building_type": lambda: F.col("c_mktsegment"),
    "area_city": lambda: F.col("r_name"),
    "community": lambda: F.col("n_name"),
    "listing_firm": lambda: F.col("listing_name"),
    "buyer_firm": lambda: _with_buyer(F.col("buyer_name")),
    "listing_agent": lambda: _agent("l_suppkey", 10),
    "buyer_agent": lambda: _with_buyer(_agent("buyer_suppkey", 7)),
}


def deals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per line item, with the asked columns (all by default).

    Customers are joined to the fewer orders, and names come last, so that line items are shuffled less often and in
    narrower rows.
    """
    asked = columns or COLUMNS
    need = set(asked)
    found = read(spark, sf_dir, "lineitem")
    if need & _PART:
        part = read(spark, sf_dir, "part")
        found = found.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if need & _ORDERS:
        orders = read(spark, sf_dir, "orders")
        if need & _CUSTOMER:
            customer = read(spark, sf_dir, "customer")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        found = found.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "listing_firm" in need:
        firm = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("listing_name"))
        found = found.join(firm, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    if need & _BUYER:
        firms = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
        found = found.withColumn("buyer_suppkey", F.col("o_custkey") % firms)
    if "buyer_firm" in need:
        firm = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("buyer_name"))
        dual = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
        key = F.when(dual, F.col("l_suppkey")).otherwise(F.col("buyer_suppkey"))
        found = found.join(firm, key == F.col("s_suppkey")).drop("s_suppkey")
    if need & _NATION:
        nation = read(spark, sf_dir, "nation")
        if "area_city" in need:
            region = read(spark, sf_dir, "region")
            nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        found = found.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return found.select(*[_column(c) for c in asked])


def brokerage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headcount per broker for every month with a shipment.

    The months are a scalar subquery (a date column has few distinct months) unfolded per broker.
    """
    shipped = read(spark, sf_dir, "lineitem").select(
        month_start(F.col("l_shipdate").cast("date")).alias("month")
    )
    months = shipped.distinct().agg(F.collect_list("month")).scalar()
    listed = (
        read(spark, sf_dir, "supplier")
        .filter(F.col("s_suppkey") % 10 != 3)
        .select("s_suppkey", F.col("s_name").alias("broker"), F.explode(months).alias("date"))
    )
    value = ((F.col("s_suppkey") + F.month("date")) % 20).cast("double")
    return listed.select("broker", "date", value.alias("value"))
