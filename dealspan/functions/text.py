"""Text cleaning and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspan.schema import MISSING_TEXT


#: White space of any kind: controls, the no-break space and the wide spaces.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Text without white space at either end."""
    return F.trim(c, F.lit(SPACES))


def known_text(c: Column) -> Column:
    """Blank text and the stand-ins for "missing" become null."""
    return F.when(~stripped(c).isin(*MISSING_TEXT), c)


def text_or_na(c: Column) -> Column:
    """Text form with ``N/A`` for null."""
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def normalize_name(c: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return stripped(F.lower(c))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, so ``re/max`` becomes ``Re/Max``."""
    words = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(words, F.initcap), "")


def currency_text(c: Column) -> Column:
    """``$1,234.50``, or ``N/A`` for null."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.round(c, 2), 2)), F.lit("N/A"))


def days_text(c: Column) -> Column:
    """``12.3 days``, or ``N/A`` for null."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.1f days", c.cast("double")))


def joined_distinct(c: Column, sep: str = ", ") -> Column:
    """Aggregate: sorted distinct values as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def underscore_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns])


def range_param(text: str) -> tuple[int, int | None]:
    """``100-500`` to its bounds; malformed text means the full range."""
    low, sep, high = text.partition("-")
    if sep and low.strip().isdigit() and high.strip().isdigit():
        return int(low), int(high)
    return 0, None
