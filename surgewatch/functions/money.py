"""Sums of amounts: in the column's own type, or exactly in integer minor units.

Without a ``scale`` an amount column is summed as it is: decimals stay
decimal, doubles stay double (so the order of partial sums can move the last
bits, and a NaN makes its sum NaN).

With a ``scale`` the caller states that amounts have at most so many decimals.
They are then summed as whole minor units (cents for ``scale=2``) and turned
back into ``double`` at the end: partial sums, re-aggregation and window sums
are exact long additions, independent of how partitions are combined. An
amount with more decimals, a NaN, or one too large for exact minor units raises
an error; nothing is rounded away. Sums beyond ±9.2e18 minor units overflow
``bigint`` and raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = float(1 << 53)   # whole numbers up to here are exact in a double


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def minor_units(col: Column | str, scale: int = 2) -> Column:
    """Whole minor units of an amount as bigint; raises if ``scale`` decimals do not hold it exactly."""
    x = _col(col).cast("double")
    units = F.rint(x * F.lit(10.0 ** scale))
    holds = (F.abs(units) <= F.lit(EXACT)) & (units / F.lit(10.0 ** scale) == x)
    message = F.concat(F.lit(f"amount does not fit {scale} decimals: "), x.cast("string"))
    return F.when(x.isNull(), F.lit(None)).when(holds, units.cast("bigint")).otherwise(F.raise_error(message).cast("bigint"))


def money_sum(col: Column | str, scale: int = 2) -> Column:
    """Exact sum of an amount column, in minor units (bigint)."""
    return F.sum(minor_units(col, scale))


def resum(col: Column | str) -> Column:
    """Sum partial sums already in minor units (for re-aggregation)."""
    return F.sum(_col(col))


def to_double(col: Column | str, scale: int = 2) -> Column:
    """Minor units back to a double amount."""
    return _col(col) / F.lit(10.0 ** scale)


def amount_sum(col: Column | str, scale: int | None = None) -> Column:
    """Sum of an amount column: in its own type, or exact for ``scale`` decimals and double."""
    return F.sum(_col(col)) if scale is None else to_double(money_sum(col, scale), scale)
