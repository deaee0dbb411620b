"""Number cleaning and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.schema import MONEY, PRICE


def parse_currency(c: Column, to: str = MONEY) -> Column:
    """``$1,234.50`` to a decimal. Bad text raises (ANSI cast)."""
    return F.translate(c, "$,", "").cast(to)


def parse_grouped(c: Column) -> Column:
    """``1,234`` to a double. Bad text raises (ANSI cast)."""
    return F.translate(c, ",", "").cast("double")


def lenient_number(c: Column, to: str = PRICE) -> Column:
    """Number or null; currency signs are not stripped, so ``$6`` is null."""
    return c.try_cast(to)


def safe_decimal(c: Column, to: str = PRICE) -> Column:
    """Number after stripping ``$`` and ``,``; null, empty or bad text is 0."""
    return F.coalesce(F.translate(c, "$,", "").try_cast(to), F.lit(0).cast(to))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_columns(df: DataFrame) -> DataFrame:
    """Apply :func:`finite_or_null` to every float or double column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: finite_or_null(F.col(f"`{n}`")) for n in names})


def floats_to_decimal(c: Column, dtype: T.DataType, to: str = "decimal(38,10)") -> Column:
    """Float values to decimals at any nesting depth; NaN and infinity become null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(c).try_cast(to)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: floats_to_decimal(x, dtype.elementType, to))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: floats_to_decimal(v, dtype.valueType, to))
    if isinstance(dtype, T.StructType):
        fields = [floats_to_decimal(c[f.name], f.dataType, to).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def decimal_items(df: DataFrame, to: str = "decimal(38,10)") -> DataFrame:
    """:func:`floats_to_decimal` over all columns of a table."""
    return df.select(
        *[floats_to_decimal(F.col(f"`{f.name}`"), f.dataType, to).alias(f.name) for f in df.schema]
    )


def mean(c: Column) -> Column:
    """Sum over count as a double; null when there is nothing to average.

    On decimals and integers the sum is exact, so the mean does not depend on row order.
    """
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def total(c: Column) -> Column:
    """Sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double; null when ``b`` is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """:func:`ratio` with 0 in place of null."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    """``a`` as a percentage of ``b``; null when ``b`` is 0 or null."""
    return ratio(a, b) * 100


def whole(c: Column) -> Column:
    """Display form of a mean: cut to the integer part."""
    return c.cast("int")


def one_place(c: Column) -> Column:
    """Display form of a ratio: one place, half to even."""
    return F.bround(c, 1)
