"""The two sides of a deal as rows.

Every two-sided count or sum reads the deals once: each deal becomes a listing row and a
buyer row, and one grouped aggregate with map-side partials replaces two scans and a join.
A firm that holds a large part of the rows is reduced inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_sides(deals: DataFrame, *carry: str, firm: bool = True, agent: bool = False) -> DataFrame:
    """One row per side: ``is_listing``, ``firm`` and/or ``agent``, plus the carried columns."""

    def side(name: str, is_listing: bool) -> Column:
        fields = [F.lit(is_listing).alias("is_listing")]
        if firm:
            fields.append(F.col(f"{name}_firm").alias("firm"))
        if agent:
            fields.append(F.col(f"{name}_agent").alias("agent"))
        return F.struct(*fields)

    both = F.inline(F.array(side("listing", True), side("buyer", False)))
    return deals.select(*[F.col(c) for c in carry], both)


def with_dual(deals: DataFrame) -> DataFrame:
    """Flag deals with the same firm on both sides; a null firm never makes a deal dual."""
    same = F.coalesce(F.col("listing_firm") == F.col("buyer_firm"), F.lit(False))
    return deals.withColumn("is_dual", same)


def side_counts(sides: DataFrame, *keys: str) -> DataFrame:
    """``n_listing`` and ``n_buyer`` per key; null keys drop out."""
    return (
        sides.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.count_if("is_listing").alias("n_listing"),
            F.count_if(~F.col("is_listing")).alias("n_buyer"),
        )
    )


def on_both_sides() -> Column:
    return (F.col("n_listing") > 0) & (F.col("n_buyer") > 0)


def any_side_total() -> Column:
    return F.col("n_listing") + F.col("n_buyer")


def both_sides_total() -> Column:
    """Total for keys seen on both sides, null for the others."""
    return F.when(on_both_sides(), any_side_total())


def half_credit(price: Column) -> Column:
    """Sum over sides: full price, but a dual deal credits half the price once."""
    return F.sum(
        F.when(~F.col("is_dual"), price)
        .when(F.col("is_listing"), price * F.expr("0.5"))
        .otherwise(F.lit(0))
    )
