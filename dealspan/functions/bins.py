"""Range labels and equal-width bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor-area edges every 500 up to 5000, labels such as 0-499.
AREA_EDGES = tuple(range(0, 5001, 500))
AREA_LABELS = tuple(f"{lo}-{lo + 499}" for lo in AREA_EDGES[:-1])

# Days-on-market edges and labels; the last range ends below 1000.
DOM_EDGES = (0, 10, 20, 30, 40, 1000)
DOM_LABELS = ("0-10", "10-20", "20-30", "30-40", "40+")

# Property-age labels, youngest first.
AGE_LABELS = ("1-2 years", "3-5 years", "5+ years", "Unknown")


def cut_no(c: Column, edges: Sequence[float]) -> Column:
    """1-based number of the left-closed range holding ``c``; null outside all ranges."""
    found = F.lit(None).cast("int")
    for no in range(len(edges) - 1, 0, -1):
        found = F.when((c >= edges[no - 1]) & (c < edges[no]), F.lit(no)).otherwise(found)
    return found


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the left-closed range holding ``c``; null outside all ranges."""
    return F.get(F.array(*[F.lit(x) for x in labels]), cut_no(c, edges) - 1)


def area_range(c: Column) -> Column:
    return cut(c, AREA_EDGES, AREA_LABELS)


def dom_range(c: Column) -> Column:
    return cut(c, DOM_EDGES, DOM_LABELS)


def age_no(sold_date: Column, year_built: Column) -> Column:
    """1-based number of the age label: up to 2 (also negative), 3 to 5, 6 and over, unknown."""
    age = F.year(sold_date) - year_built
    return F.when(age.isNull(), 4).when(age <= 2, 1).when(age <= 5, 2).otherwise(3)


def age_category(sold_date: Column, year_built: Column) -> Column:
    """Label of the age at sale."""
    labels = F.array(*[F.lit(x) for x in AGE_LABELS])
    return F.get(labels, age_no(sold_date, year_built) - 1)


def equal_width(c: Column, low: Column, high: Column, n: int) -> Column:
    """1-based equal-width bin on ``[low, high]``; the right edge falls in the last bin."""
    bucket = F.width_bucket(c.cast("double"), low, high, F.lit(n))
    return (
        F.when(c.isNull(), F.lit(None))
        .when(low == high, F.lit(1))
        .otherwise(F.least(bucket, F.lit(n)))
        .cast("int")
    )
