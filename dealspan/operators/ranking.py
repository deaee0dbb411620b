"""Top lists, ranks and the best row of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, metric: str, *keys: str, n: int = 10) -> DataFrame:
    """Largest ``n`` rows; ties go to the smaller key."""
    return df.orderBy(F.desc(metric), *keys).limit(n)


def bottom_n(df: DataFrame, metric: str, *keys: str, n: int = 10) -> DataFrame:
    """Smallest ``n`` rows; ties go to the smaller key."""
    return df.orderBy(F.asc(metric), *keys).limit(n)


def top_keys(
    totals: DataFrame, metric: str, key: str, n: int = 10, pin: str | None = None
) -> DataFrame:
    """Keys of the ``n`` largest totals, plus a pinned key. At most ``n + 1`` rows."""
    top = top_n(totals, metric, key, n=n).select(key)
    if pin is None:
        return top
    pinned = totals.sparkSession.range(1).select(F.lit(pin).alias(key))
    return top.filter(F.col(key) != pin).union(pinned)


def top_and_pinned(
    totals: DataFrame, metric: str, key: str, n: int = 10, pin: str | None = None
) -> DataFrame:
    """Rows of the ``n`` largest totals, plus a pinned key's row, in one pass over the totals.

    The pinned row sorts first, so it is among the ``n + 1`` rows that are taken; the rank runs over
    those alone.
    """
    if pin is None:
        return top_n(totals, metric, key, n=n)
    pinned = F.coalesce(F.col(key) == F.lit(pin), F.lit(False))
    few = totals.orderBy(F.desc(pinned), F.desc(metric), key).limit(n + 1)
    place = F.row_number().over(Window.orderBy(F.desc(metric), key))
    return few.withColumn("_place", place).filter((F.col("_place") <= n) | pinned).drop("_place")


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the key table."""
    return df.join(keys.select(key), key, "left_semi")


def dense_rank_counts(totals: DataFrame, metric: str, name: str = "ranking") -> DataFrame:
    """Dense rank by a count, largest first.

    Only the distinct counts go through the ordered window. ``k`` distinct positive counts add
    up to at least ``k(k+1)/2`` input rows, so ``k`` is below ``sqrt(2 * rows)``: a million
    values for a trillion deal sides. How the ranks are joined is left to their size.
    """
    distinct = totals.select(metric).distinct()
    ranks = distinct.withColumn(name, F.dense_rank().over(Window.orderBy(F.desc(metric))))
    return totals.join(ranks, metric)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under the given order.

    ``row_number() = 1`` plans a limit inside each task before the shuffle, so a hot key
    sends at most one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter("_rn = 1").drop("_rn")


#: Bytes of an id that take part in the order of ``day_and_id``.
ID_BYTES = 12


def day_and_id(day: str, identifier: str, flag: Column | None = None) -> Column:
    """One number in the order of a flag (false first), a date and the first ``ID_BYTES`` bytes of a text id, nulls first.

    A number has a fixed width, so its ``min`` stays in a hash aggregate, where text would sort all rows first.
    """
    digits = F.rpad(F.substring(F.hex(F.coalesce(identifier, F.lit(""))), 1, 2 * ID_BYTES), 2 * ID_BYTES, "0")
    half = lambda at: F.conv(F.substring(digits, at, ID_BYTES), 16, 10).cast("decimal(15,0)")
    rest = half(1) * F.lit(1 << (4 * ID_BYTES)).cast("decimal(15,0)") + half(1 + ID_BYTES)
    days = F.coalesce(F.unix_date(day).cast("long") + (1 << 23), F.lit(0))
    if flag is not None:
        days = days + F.when(flag, 1 << 24).otherwise(0)
    # 2 ** 96 has 29 digits
    return (days.cast("decimal(8,0)") * F.expr("100000000000000000000000000000BD") + rest).cast("decimal(38,0)")


def first_value_per_key(
    df: DataFrame, key: str, value: str, order: Column | str, name: str | None = None
) -> DataFrame:
    """First non-null value per key by an order of fixed width; ties go to the smaller value.

    Rows are first reduced to one for each key and value by a hash aggregate.
    """
    order = F.col(order) if isinstance(order, str) else order
    known = df.dropna(subset=[key, value])
    pairs = known.groupBy(key, value).agg(F.min(order).alias("_order"))
    first = best_per_key(pairs, [key], [F.asc_nulls_first("_order"), F.asc(value)])
    return first.select(key, F.col(value).alias(name or value))


def most_frequent(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smaller value."""
    counts = df.dropna(subset=[key, value]).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct(-F.col("_n"), value))[value].alias(name))
