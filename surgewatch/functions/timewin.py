"""Time columns: hour buckets, epoch seconds, anchored lookbacks, relative months.

Window bounds are always computed on the driver from an injected anchor
("now" is never read inside a query), then cast to the column's own type so
that Catalyst folds them to literals and pushes the range into the scan.

Column types handled: ``timestamp_ntz`` (wall-clock, time-zone free),
``timestamp`` (instant, bucketed in the session time zone) and ISO strings
(cast to ``timestamp`` first, as a store's date string would be).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDS = ("[)", "(]", "[]", "()")


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_time(col: Column, dtype: T.DataType) -> Column:
    """Strings become ``timestamp``; timestamp types are kept."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return col
    return col.cast("timestamp")


def time_type(dtype: T.DataType) -> str:
    return "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"


def hour_bucket(col: Column, dtype: T.DataType) -> Column:
    """Start of the hour a value falls in, of the same time type.

    Equal to cutting the ISO text after the hour and reading it back. For
    ``timestamp_ntz`` the hour is rebuilt from its fields, so the result does
    not depend on the session time zone; ``date_trunc`` would turn it into an
    instant. ISO text carrying a UTC offset is converted to the session time
    zone first (cutting the text would keep the writer's local hour instead).
    """
    if isinstance(dtype, T.TimestampNTZType):
        return F.make_timestamp_ntz(
            F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.lit(0), F.lit(0)
        )
    return F.date_trunc("hour", as_time(col, dtype))


def epoch_seconds(col: Column, dtype: T.DataType) -> Column:
    """Whole seconds since the epoch; wall-clock (UTC) seconds for ``timestamp_ntz``."""
    return F.unix_timestamp(as_time(col, dtype))


def _parse(value: str | datetime | date) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def time_literal(value: datetime, dtype: T.DataType) -> Column:
    text = value.isoformat(sep=" ")
    return F.lit(text).cast(time_type(dtype))


def add_months(value: datetime, months: int) -> datetime:
    """Calendar month arithmetic; the day is clipped to the target month's end."""
    index = value.year * 12 + (value.month - 1) + months
    year, month = divmod(index, 12)
    month += 1
    next_first = date(year + (month == 12), month % 12 + 1, 1)
    last_day = (next_first - timedelta(days=1)).day
    return value.replace(year=year, month=month, day=min(value.day, last_day))


def in_range(col: Column, dtype: T.DataType, low: datetime, high: datetime, bounds: str = "[)") -> Column:
    if bounds not in BOUNDS:
        raise ValueError(f"bounds must be one of {BOUNDS}, got {bounds!r}")
    col = as_time(col, dtype)
    lo, hi = time_literal(low, dtype), time_literal(high, dtype)
    left = col >= lo if bounds[0] == "[" else col > lo
    right = col <= hi if bounds[1] == "]" else col < hi
    return left & right


def lookback(col: Column, dtype: T.DataType, anchor, days: int = 90, bounds: str = "[)") -> Column:
    """``anchor - days`` to ``anchor``; ``"[)"`` is the job's form, ``"(]"`` the HTTP query's."""
    end = _parse(anchor)
    return in_range(col, dtype, end - timedelta(days=days), end, bounds)


def relative_month(col: Column, dtype: T.DataType, now, months: int = 1, bounds: str = "[)") -> Column:
    """``now - months`` to ``now``, calendar months; ``now`` is injected by the caller."""
    end = _parse(now)
    return in_range(col, dtype, add_months(end, -months), end, bounds)


def day_range(col: Column, dtype: T.DataType, now, months: int = 1) -> Column:
    """The same month range with day-precision dates, as two chained filters would do.

    ``col < date(now)`` and ``col >= date(now - months)``: a date compared with a
    timestamp means midnight, so rows of the current day fall out.
    """
    end = _parse(now).date()
    start = add_months(datetime(end.year, end.month, end.day), -months).date()
    col = as_time(col, dtype)
    return (col < F.lit(end)) & (col >= F.lit(start))
