"""Filters over deals: one parameter object instead of query strings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING, BUYER, DUAL = "listing", "buyer", "dual"


def either_in(a: str, b: str, values: Sequence) -> Column:
    """One of two columns is in the selection."""
    return F.col(a).isin(*values) | F.col(b).isin(*values)


def either_is(a: str, b: str, value) -> Column:
    """One of two columns equals the value."""
    return (F.col(a) == value) | (F.col(b) == value)


def differs(a: Column | str, b) -> Column:
    """Inequality under which a null differs from every value."""
    left = F.col(a) if isinstance(a, str) else a
    return ~left.eqNullSafe(b)


@dataclass(frozen=True)
class DealFilter:
    """Selection of deals. Every unset field filters nothing; a set range drops nulls."""

    start: date | None = None
    end: date | None = None
    cities: tuple[str, ...] = ()
    communities: tuple[str, ...] = ()
    building_types: tuple[str, ...] = ()
    property_classes: tuple[str, ...] = ()
    years_built: tuple[int, ...] = ()
    firms: tuple[str, ...] = ()  # on either side of the deal
    listing_firms: tuple[str, ...] = ()  # on the listing side only
    agents: tuple[str, ...] = ()  # on either side of the deal
    price: tuple[float, float | None] | None = None
    days_on_market: tuple[float, float | None] | None = None
    baths: tuple[int, int | None] | None = None
    bedrooms: tuple[int, int | None] | None = None
    transaction: str | None = None  # LISTING, BUYER or DUAL
    month: int | None = None
    years: tuple[int, ...] = ()
    located: bool = False  # keep only deals with a city and a community

    def conditions(self) -> list[Column]:
        found: list[Column] = []
        if self.start:
            found.append(F.col("sold_date") >= F.lit(self.start))
        if self.end:
            found.append(F.col("sold_date") <= F.lit(self.end))
        if self.years:
            # The date range reaches the scan; the year test alone would not.
            found.append(F.col("sold_date") >= F.lit(date(min(self.years), 1, 1)))
            found.append(F.col("sold_date") <= F.lit(date(max(self.years), 12, 31)))
            found.append(F.year("sold_date").isin(*self.years))
        if self.month:
            found.append(F.month("sold_date") == self.month)
        for name, chosen in (
            ("area_city", self.cities),
            ("community", self.communities),
            ("building_type", self.building_types),
            ("property_class", self.property_classes),
            ("year_built", self.years_built),
            ("listing_firm", self.listing_firms),
        ):
            if chosen:
                found.append(F.col(name).isin(*chosen))
        for name, bounds in (
            ("sold_price", self.price),
            ("days_on_market", self.days_on_market),
            ("total_baths", self.baths),
            ("total_bedrooms", self.bedrooms),
        ):
            if bounds:
                found.append(F.col(name) >= bounds[0])
                if bounds[1] is not None:
                    found.append(F.col(name) <= bounds[1])
        if self.firms:
            found.append(either_in("listing_firm", "buyer_firm", self.firms))
        if self.agents:
            found.append(either_in("listing_agent", "buyer_agent", self.agents))
        if self.transaction == LISTING:
            found.append(F.col("listing_firm").isNotNull())
        elif self.transaction == BUYER:
            found.append(F.col("buyer_firm").isNotNull())
        elif self.transaction == DUAL:
            found.append(F.col("listing_firm") == F.col("buyer_firm"))
        if self.located:
            found += [F.col("area_city").isNotNull(), F.col("community").isNotNull()]
        return found

    def apply(self, deals: DataFrame) -> DataFrame:
        found = self.conditions()
        return deals.filter(reduce(and_, found)) if found else deals


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct sorted non-null values of a column."""
    return df.select(column).dropna().distinct().orderBy(column)


def options_union(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Distinct sorted non-null values found in either of two columns, in one scan."""
    values = df.select(F.explode(F.array(F.col(a), F.col(b))).alias(name))
    return values.dropna().distinct().orderBy(name)


def communities_of(df: DataFrame, cities: Sequence[str] = ()) -> DataFrame:
    """Community options inside the chosen cities; no choice means every known city."""
    inside = F.col("area_city").isin(*cities) if cities else F.col("area_city").isNotNull()
    return options(df.filter(inside), "community")


def require_dates(flt: DealFilter, what: str) -> None:
    """Reports on a grid of the filter's months or years need both dates."""
    if flt.start is None or flt.end is None:
        raise ValueError(f"{what} needs the filter's start and end")
