"""The alert rule and the spike metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three class names of the label column, most severe first.
BIG_SPIKE = "BIG_SPIKE"
SPIKE = "SPIKE"
NO_SPIKE = "NO_SPIKE"
LABELS = (BIG_SPIKE, SPIKE, NO_SPIKE)


def diff(last24h: str = "last24h_amount", daily: str = "daily_amount") -> Column:
    """Trailing total minus the daily baseline."""
    return F.col(last24h) - F.col(daily)


def pct(last24h: str = "last24h_amount", daily: str = "daily_amount") -> Column:
    """``(last24h - daily) / daily * 100``; NULL when the baseline is 0 or NULL.

    ``try_divide`` keeps ANSI mode from raising on a zero baseline; the NULL
    later removes the row. (A Java double rate would be NaN/Infinity instead.)
    """
    return F.try_divide(diff(last24h, daily), F.col(daily)) * F.lit(100)


def alert_rule(amount_threshold: str, pct_threshold: str,
               last24h: str = "last24h_amount", daily: str = "daily_amount") -> Column:
    """``amount_threshold < diff AND pct_threshold < pct``, both strict.

    Three-valued: a NULL threshold gives NULL or false, never true.
    """
    return (F.col(amount_threshold) < diff(last24h, daily)) & (F.col(pct_threshold) < pct(last24h, daily))


def label(big_spike: str = "big_spike", spike: str = "spike") -> Column:
    """Big spike first, then spike, else no spike; a NULL flag counts as not set."""
    return (F.when(F.col(big_spike) == F.lit(True), F.lit(BIG_SPIKE))
            .when(F.col(spike) == F.lit(True), F.lit(SPIKE))
            .otherwise(F.lit(NO_SPIKE)))
