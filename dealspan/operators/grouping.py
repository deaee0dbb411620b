"""Counts, shares, grids, pivots and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealspan.functions.bins import cut_no, equal_width
from dealspan.functions.dates import month_start
from dealspan.functions.numbers import percent
from dealspan.operators.ranking import top_n


def count_by(df: DataFrame, *keys: str, name: str = "deals") -> DataFrame:
    """Rows per key; null keys drop out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, key: str, name: str = "deals") -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    return count_by(df, key, name=name).orderBy(F.desc(name), key)


def with_share(counts: DataFrame, metric: str, name: str = "share_pct") -> DataFrame:
    """Each row's percentage of the column total.

    The total is a scalar subquery: no join, and no window that gathers all groups.
    """
    whole = counts.agg(F.sum(metric)).scalar()
    return counts.withColumn(name, percent(F.col(metric), whole))


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_start(F.col("sold_date")))


def complete_months(keys: DataFrame, months: Sequence[date]) -> DataFrame:
    """Every key with every month: the month list unfolds per row, nothing is joined."""
    listed = F.array(*[F.lit(m) for m in months]) if months else F.array().cast("array<date>")
    return keys.withColumn("month", F.explode(listed))


def with_market(deals: DataFrame, key: str) -> DataFrame:
    """Deals per key and month next to all deals of the month, from one aggregate.

    A null key stays a group, so that a month's groups add up to all its deals.
    """
    counts = with_month(deals).dropna(subset=["month"]).groupBy(key, "month").agg(F.count(F.lit(1)).alias("deals"))
    return counts.withColumn("total_deals", F.sum("deals").over(Window.partitionBy("month")))


def filled_months(deals: DataFrame, key: str, months: Sequence[date], name: str = "deals") -> DataFrame:
    """Deals of every key in every month of the list, 0 where it has none.

    A key's counts, at most one for each calendar month, stay with it, so keys and counts come from one read.
    """
    counts = with_month(deals).dropna(subset=[key]).groupBy(key, "month").agg(F.count(F.lit(1)).alias("_n"))
    cells = F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "_n")))
    grid = complete_months(counts.groupBy(key).agg(F.map_from_entries(cells).alias("_cells")), months)
    return grid.select(key, "month", F.coalesce(F.col("_cells")[F.col("month")], F.lit(0)).alias(name))


def binned_counts(
    df: DataFrame, key: str, number: Column, labels: Sequence[str], bin_name: str,
    name: str = "deals", top: int | None = None,
) -> DataFrame:
    """Rows per key and labelled bin, with 0 for a key's empty bins.

    ``number`` is the 1-based bin of a row, null outside all bins. One conditional count per
    bin in a single grouped pass, unfolded afterwards; ``top`` keeps the keys with most rows
    (in or out of the bins) before unfolding, so no join is needed.
    """
    counts = [F.count_if(F.col("_no") == i).alias(f"_b{i}") for i in range(1, len(labels) + 1)]
    wide = (
        df.dropna(subset=[key])
        .select(key, number.alias("_no"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), *counts)
    )
    if top is not None:
        wide = top_n(wide, "_rows", key, n=top)
    cells = [
        F.struct(F.lit(i).alias("bin_no"), F.lit(text).alias(bin_name), F.col(f"_b{i}").alias(name))
        for i, text in enumerate(labels, 1)
    ]
    return wide.select(key, F.inline(F.array(*cells)))


def zero_filled_bins(
    df: DataFrame, key: str, column: str, edges: Sequence[float], labels: Sequence[str],
    bin_name: str, top: int | None = None,
) -> DataFrame:
    """:func:`binned_counts` over the left-closed ranges of a numeric column."""
    return binned_counts(df, key, cut_no(F.col(column), edges), labels, bin_name, top=top)


def pivot_sum(
    df: DataFrame, index: str, column: str, values: Sequence, labels: Sequence[str], metric: str
) -> DataFrame:
    """Wide table with one 0-filled column per listed value.

    The list is always given, so no extra job looks for the values.
    """
    wide = df.groupBy(index).pivot(column, list(values)).agg(F.sum(metric))
    found = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(x) for v, x in zip(values, labels)]
    return wide.select(index, *found)


def histogram(df: DataFrame, column: str, n: int, *by: str, name: str = "deals") -> DataFrame:
    """Equal-width bins over the column's own range, counted per bin and per ``by`` key.

    Nulls drop out. The rows are read once, see :func:`_binned`.
    """
    return _binned(df, {column: n}, by, name)


def histogram_2d(df: DataFrame, x: str, y: str, nx: int, ny: int, name: str = "deals") -> DataFrame:
    """Counts per cell of an equal-width grid over two columns; empty cells are left out."""
    return _binned(df, {x: nx, y: ny}, (), name)


def _binned(df: DataFrame, columns: dict[str, int], by: Sequence[str], name: str) -> DataFrame:
    """Bins over each column's range, from counts per distinct value.

    The range is a scalar subquery over the same counts. It uses all their columns, so that its plan down to the
    shuffle is the same as the bins' own and Spark runs that part once.
    """
    values = df.dropna(subset=[*columns, *by]).groupBy(*columns, *by).agg(F.count(F.lit(1)).alias("_n"))
    ranges = [F.sum("_n").alias("_rows"), *(F.max(F.hash(c)).alias(f"_{c}") for c in by)]
    for c in columns:
        value = F.col(c).cast("double")
        ranges += [F.min(value).alias(f"low_{c}"), F.max(value).alias(f"high_{c}")]
    found = values.agg(F.struct(*ranges)).scalar()
    bins = [
        equal_width(F.col(c), found[f"low_{c}"], found[f"high_{c}"], n).alias(f"{c}_bin")
        for c, n in columns.items()
    ]
    keys = [*(f"{c}_bin" for c in columns), *by]
    return values.select(*by, *bins, "_n").groupBy(*keys).agg(F.sum("_n").alias(name))


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left lookup with a default for unknown keys."""
    found = df.join(mapping, key, "left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))
