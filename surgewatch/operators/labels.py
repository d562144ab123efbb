"""Spike metrics, flags and the label, joined from hourly totals and the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgewatch.functions import alerts
from surgewatch.operators.baseline import THRESHOLD_COLUMNS

HOURLY_COLUMNS = ("client_id", "country", "hour", "amount", "last24h_amount")


def spike_metrics(last24h: DataFrame, baseline_thresholds: DataFrame) -> DataFrame:
    """Hourly rows x baseline on (client_id, country) plus ``diff`` and ``pct``.

    Both inputs arrive partitioned by (client_id, country) when they come
    from the trailing window and the baseline join, so the join adds no
    shuffle of the hourly side.
    """
    joined = last24h.select(*HOURLY_COLUMNS).join(baseline_thresholds, ["client_id", "country"])
    return joined.select(*HOURLY_COLUMNS, "daily_amount", *THRESHOLD_COLUMNS,
                         alerts.diff().alias("diff"), alerts.pct().alias("pct"))


def spike_flags(metrics: DataFrame) -> DataFrame:
    """``spike`` and ``big_spike``: the alert rule with each threshold pair."""
    return metrics.select("*", alerts.alert_rule("spike_amount", "spike_pct").alias("spike"),
                          alerts.alert_rule("big_spike_amount", "big_spike_pct").alias("big_spike"))


def spike_label(flags: DataFrame) -> DataFrame:
    """``label`` (big spike first, then spike, else none); rows without a pct are dropped."""
    return flags.select("*", alerts.label().alias("label")).filter(F.col("pct").isNotNull())
