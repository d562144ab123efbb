"""The client's baseline: latest monthly row(s), daily rate, thresholds attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.session import broadcast_if_small


def latest_month(history: DataFrame, keys: Sequence[str] = ("client_id", "country"),
                 month: str = "month") -> DataFrame:
    """``max(month)`` per key."""
    return history.groupBy(*keys).agg(F.max(month).alias(month))


def latest_rows(history: DataFrame, keys: Sequence[str] = ("client_id", "country"), month: str = "month",
                method: str = "window") -> DataFrame:
    """Every row of a key whose ``month`` equals the key's latest month.

    Duplicates of the latest month all stay (they multiply later joins, as the
    job does); rows with a NULL key or month never match.

    ``method="window"`` (default): ``rank() == 1`` over the key: one scan and
    one shuffle. Spark evaluates the rank filter inside each map task before
    the shuffle as well (a partial ``WindowGroupLimit``), so a hot key ships
    only its latest-month rows, which are all part of the result anyway.
    ``method="join"``: ``max`` per key with partial aggregation, then an
    equi-join back (the self-join form): two scans and more shuffles, but a
    hot join key is split by AQE's skew-join handling.
    """
    if method == "window":
        win = Window.partitionBy(*keys).orderBy(F.col(month).desc())
        ok = F.lit(True)
        for k in (*keys, month):
            ok = ok & F.col(k).isNotNull()
        return (history.filter(ok).withColumn("_rank", F.rank().over(win))
                .filter(F.col("_rank") == 1).drop("_rank"))
    if method != "join":
        raise ValueError(f"method must be 'join' or 'window', got {method!r}")
    return history.join(latest_month(history, keys, month), [*keys, month])


def daily_rate(latest: DataFrame, amount: str = "amount", days: int = 30, out: str = "daily_amount",
               keys: Sequence[str] = ("client_id", "country")) -> DataFrame:
    """Monthly amount / ``days`` (a constant, not the month's length)."""
    return latest.select(*keys, "month", (F.col(amount) / F.lit(days)).alias(out))


THRESHOLD_COLUMNS = ("spike_amount", "big_spike_amount", "spike_pct", "big_spike_pct")


def with_thresholds(baseline: DataFrame, thresholds: DataFrame, on: str = "country",
                    max_threshold_rows: int = 10_000,
                    keys: Sequence[str] = ("client_id", "country"), value: str = "daily_amount") -> DataFrame:
    """Attach the country's thresholds (inner join; a duplicated country multiplies rows).

    The thresholds are broadcast only after a count proves them small.
    """
    small = broadcast_if_small(thresholds.select(on, *THRESHOLD_COLUMNS), max_threshold_rows)
    return baseline.join(small, on).select(*keys, value, *THRESHOLD_COLUMNS)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (the rows that would fan out a join)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)
