"""From exported text to typed tables and stored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.functions.dates import KNOWN_FORMATS, lenient_date, strict_date
from dealspan.functions.numbers import (
    decimal_items,
    finite_columns,
    lenient_number,
    parse_currency,
    parse_grouped,
    safe_decimal,
)
from dealspan.functions.text import known_text, stripped, text_or_na
from dealspan.schema import (
    BROKERAGE,
    BROKERAGE_DISPLAY_NAMES,
    DEALS,
    DISPLAY_NAMES,
    MISSING_TEXT,
    PRICE,
)
from dealspan.sources.readers import require_column, to_canonical_names

TEXT_COLUMNS = tuple(f.name for f in DEALS if f.dataType.typeName() == "string")

# Attributes of a stored listing: text first, then numbers.
ITEM_TEXT = (
    "property_class", "area_city", "community", "building_type", "style", "address", "status",
    "listing_agent", "buyer_agent", "listing_firm", "buyer_firm",
)
ITEM_NUMBERS = (
    "list_price", "sold_price", "total_bedrooms", "total_baths", "year_built", "price_per_sqft",
)


def clean_deals(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Exported listings (all text) to the typed deals table.

    Missing-value text becomes null. ``strict`` raises on bad prices, areas, dates and numbers, and on a
    fraction where a whole number is stored; otherwise they become null. Columns the export lacks are skipped.
    """
    named = to_canonical_names(raw)
    found = []
    for field in DEALS:
        if field.name not in named.columns:
            continue
        text = known_text(F.col(field.name))
        if field.name in TEXT_COLUMNS:
            value = text
        elif field.name == "sold_date":
            value = strict_date(text) if strict else lenient_date(text, KNOWN_FORMATS)
        elif field.name in ("list_price", "sold_price", "price_per_sqft"):
            to = field.dataType.simpleString()
            value = parse_currency(text, to) if strict else lenient_number(F.translate(stripped(text), "$,", ""), to)
        elif field.name == "total_flr_area_sf":
            value = parse_grouped(text) if strict else F.translate(stripped(text), ",", "").try_cast("double")
        else:
            plain = F.translate(stripped(text), ",", "")
            value = _counted(plain.cast("double") if strict else plain.try_cast("double"), field.dataType, strict)
        found.append(value.alias(field.name))
    return named.select(*found)


def _counted(value: Column, to: T.DataType, strict: bool) -> Column:
    """A number in its stored type; a whole number is never made by cutting a fraction off."""
    if not isinstance(to, T.IntegerType):
        return value.try_cast(to)
    whole = F.when(value == F.floor(value), value.try_cast(to))
    if not strict:
        return whole
    return F.when(value.isNull() | whole.isNotNull(), whole).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string"))).cast(to))


def clean_brokerage(raw: DataFrame) -> DataFrame:
    """Exported headcounts (all text) to the typed brokerage table; rows need a broker."""
    shown = {v: k for k, v in BROKERAGE_DISPLAY_NAMES.items()}
    named = raw.withColumnsRenamed({k: v for k, v in shown.items() if k in raw.columns})
    require_column(named, "broker")
    values = {
        "broker": known_text(F.col("broker")),
        "date": lenient_date(F.col("date"), KNOWN_FORMATS),
        "value": F.col("value").try_cast("double"),
        "firm": known_text(F.col("firm")),
    }
    found = [values[f.name].alias(f.name) for f in BROKERAGE if f.name in named.columns]
    return named.select(*found).dropna(subset=["broker"])


def listing_items(raw: DataFrame) -> DataFrame:
    """Exported listings as the 19 stored attributes: ``N/A`` for null text, 0 for bad numbers.

    Columns the export lacks, the id apart, are stored with the same defaults.
    """
    named = to_canonical_names(raw)
    absent = [c for c in ("sold_date", *ITEM_TEXT, *ITEM_NUMBERS) if c not in named.columns]
    named = named.withColumns({c: F.lit(None).cast("string") for c in absent})
    return named.select(
        F.col("listing_id").cast("string").alias("listing_id_#"),
        text_or_na(F.col("sold_date")).alias("sold_date"),
        *[text_or_na(F.col(c)).alias(c) for c in ITEM_TEXT],
        *[safe_decimal(F.col(c).cast("string"), PRICE).alias(c) for c in ITEM_NUMBERS],
    )


def brokerage_items(raw: DataFrame, key: str = "broker") -> DataFrame:
    """Headcounts as stored items: key required, null keys dropped, floats as decimals."""
    require_column(raw, key)
    known = raw.filter(F.col(key).isNotNull() & ~stripped(F.col(key)).isin(*MISSING_TEXT))
    text = [c for c in (key, "firm") if c in raw.columns]
    return decimal_items(finite_columns(known.withColumns({c: F.col(c).cast("string") for c in text})))


def item_columns() -> list[str]:
    return ["listing_id_#", "sold_date", *ITEM_TEXT, *ITEM_NUMBERS]


def export_text(deals: DataFrame) -> DataFrame:
    """Typed deals as an export would show them: headers, ``M/d/yyyy``, ``$1,234.5000``."""
    shown = []
    for field in DEALS:
        if field.name not in deals.columns:
            continue
        c = F.col(field.name)
        if field.name == "sold_date":
            text = F.date_format(c, "M/d/yyyy")
        elif field.name in ("list_price", "sold_price", "price_per_sqft"):
            text = F.concat(F.lit("$"), F.format_number(c, field.dataType.scale))
        elif field.name == "total_flr_area_sf":
            text = F.format_number(c, 2)
        else:
            text = c.cast("string")
        shown.append(F.coalesce(text, F.lit("N/A")).alias(DISPLAY_NAMES[field.name]))
    return deals.select(*shown)
