"""Table schemas, column names and the text values that mean "missing"."""

from pyspark.sql import types as T

MONEY = "decimal(18,2)"
PRICE = "decimal(18,4)"

DEALS = T.StructType(
    [
        T.StructField("listing_id", T.StringType()),
        T.StructField("sold_date", T.DateType()),
        T.StructField("list_price", T.DecimalType(18, 2)),
        T.StructField("sold_price", T.DecimalType(18, 4)),
        T.StructField("total_flr_area_sf", T.DoubleType()),
        T.StructField("price_per_sqft", T.DecimalType(18, 4)),
        T.StructField("total_bedrooms", T.IntegerType()),
        T.StructField("total_baths", T.DoubleType()),  # half baths
        T.StructField("year_built", T.IntegerType()),
        T.StructField("days_on_market", T.IntegerType()),
        T.StructField("sold_list_ratio", T.DoubleType()),
        T.StructField("property_class", T.StringType()),
        T.StructField("building_type", T.StringType()),
        T.StructField("style", T.StringType()),
        T.StructField("area_city", T.StringType()),
        T.StructField("community", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("listing_agent", T.StringType()),
        T.StructField("buyer_agent", T.StringType()),
        T.StructField("listing_firm", T.StringType()),
        T.StructField("buyer_firm", T.StringType()),
    ]
)

BROKERAGE = T.StructType(
    [
        T.StructField("broker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("firm", T.StringType()),
    ]
)

# Column headers of the listings export, by canonical name.
DISPLAY_NAMES = {
    "listing_id": "Listing ID #",
    "sold_date": "Sold Date",
    "list_price": "List Price",
    "sold_price": "Sold Price",
    "total_flr_area_sf": "Total Flr Area (SF)",
    "price_per_sqft": "Price Per SQFT",
    "total_bedrooms": "Total Bedrooms",
    "total_baths": "Total Baths",
    "year_built": "Year Built",
    "days_on_market": "Days On Market",
    "sold_list_ratio": "Sold Pr / List Pr Ratio",
    "property_class": "Property Class",
    "building_type": "Building Type",
    "style": "Style",
    "area_city": "Area/City",
    "community": "Community",
    "address": "Address",
    "status": "Status",
    "listing_agent": "Listing Agent 1 - Agent Name",
    "buyer_agent": "Buyer Agent 1 - Agent Name",
    "listing_firm": "Listing Firm 1 - Office Name",
    "buyer_firm": "Buyer Firm 1 - Office Name",
}
CANONICAL_NAMES = {shown: name for name, shown in DISPLAY_NAMES.items()}

# Column headers of the headcount export.
BROKERAGE_DISPLAY_NAMES = {"broker": "Broker", "date": "Date", "value": "Value", "firm": "firm"}

# Logical table names and the tables they stand for.
TABLE_ALIASES = {
    "listings": "deals",
    "real_estate_listings": "deals",
    "brokerage_data": "brokerage",
}

# Text that stands for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "NaT", "None", "n/a", "nan", "none", "null",
)


def raw_listings_schema() -> T.StructType:
    """All-text schema of a listings export, headers as shown to the user."""
    return T.StructType([T.StructField(h, T.StringType()) for h in DISPLAY_NAMES.values()])
