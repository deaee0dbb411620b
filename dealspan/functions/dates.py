"""Date parsing and calendar buckets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts found in the exports; M/d accepts padded and unpadded text.
EXPORT_FORMAT = "M/d/yyyy"
KNOWN_FORMATS = (
    EXPORT_FORMAT, "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]",
    "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm", "yyyy/MM/dd",
)

# Calendar order of month names.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def strict_date(c: Column, fmt: str = EXPORT_FORMAT) -> Column:
    """Date in one layout; bad text raises (ANSI)."""
    return F.to_date(c, fmt)


def lenient_date(c: Column, formats: tuple[str, ...] = (EXPORT_FORMAT,)) -> Column:
    """Date in the first layout that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def day(c: Column) -> Column:
    """Timestamp cut to its day."""
    return c.cast("date")


def month_start(c: Column) -> Column:
    """First day of the month."""
    return F.trunc(c, "MM")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def month_label(c: Column) -> Column:
    """``Jan-2024``."""
    return F.date_format(c, "MMM-yyyy")


def months_between(start: date, end: date) -> list[date]:
    """Month starts inside the range; a range that opens mid-month skips that month."""
    at = start if start.day == 1 else _next_month(start)
    found = []
    while at <= end:
        found.append(at)
        at = _next_month(at)
    return found


def months_touched(start: date, end: date) -> list[date]:
    """Month starts of every month the range overlaps."""
    return months_between(start.replace(day=1), end)


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)
