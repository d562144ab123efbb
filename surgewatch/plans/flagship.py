"""The spike labelling job as one plan.

    sales --filter(lookback)--> hourly sums --> trailing 24 h total --+
    history --> latest month rows --> / 30 --> x thresholds ---------+--> metrics --> flags --> label

Shuffles: one for the hourly sums (after map-side partial sums), one for
the trailing window by (client, country), one for the baseline. The final
join reuses the window's partitioning, and AQE turns it into a broadcast
join when the baseline is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from surgewatch.functions.timewin import column_type, lookback
from surgewatch.operators import baseline, labels, rollup
from surgewatch.session import checkpointed
from surgewatch.sources import fixtures
from surgewatch.sources.fixtures import Tables

# The job's default anchor, lookback and baseline divisor.
DEFAULT_ANCHOR = "2018-06-12T08:50:01"
DEFAULT_LOOKBACK_DAYS = 90
DAYS_PER_MONTH = 30
WINDOW_SECONDS = 24 * 3600


def baseline_thresholds(history: DataFrame, thresholds: DataFrame, latest_method: str = "window",
                        days_per_month: int = DAYS_PER_MONTH) -> DataFrame:
    latest = baseline.latest_rows(history, method=latest_method)
    daily = baseline.daily_rate(latest, days=days_per_month)
    return baseline.with_thresholds(daily, thresholds)


def label_hourly(hourly: DataFrame, history: DataFrame, thresholds: DataFrame,
                 window_seconds: int = WINDOW_SECONDS, latest_method: str = "window",
                 days_per_month: int = DAYS_PER_MONTH, scale: int | None = None) -> DataFrame:
    """Label hourly sales (client_id, country, hour, amount) against the baseline."""
    last24 = rollup.trailing_sum(hourly, seconds=window_seconds, scale=scale)
    base = baseline_thresholds(history, thresholds, latest_method, days_per_month)
    return labels.spike_label(labels.spike_flags(labels.spike_metrics(last24, base)))


def label_spikes(sales: DataFrame, history: DataFrame, thresholds: DataFrame,
                 anchor: str | None = DEFAULT_ANCHOR, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                 window_seconds: int = WINDOW_SECONDS, latest_method: str = "window",
                 ts: str = "sold_at", co_partition: bool = False, client: str = "client_id",
                 country: str = "country", amount: str = "amount", scale: int | None = None) -> DataFrame:
    """The whole job over sales rows: flat (client_id, country, sold_at, amount) by default.

    Column names may be dotted paths into a document's nested struct
    (``client="details.client_id"``). ``ts`` is a top-level column.
    ``anchor=None`` keeps all sales; otherwise ``[anchor - lookback_days, anchor)``.
    ``scale`` states the amounts' decimals and makes the sums exact (see ``functions.money``).
    """
    if anchor is not None:
        sales = sales.filter(lookback(sales[ts], column_type(sales, ts), anchor, lookback_days, "[)"))
    hourly = rollup.hourly_sales(sales, client=client, country=country, ts=ts, amount=amount,
                                 co_partition=co_partition, scale=scale)
    return label_hourly(hourly, history, thresholds, window_seconds, latest_method, scale=scale)


def sales_window(anchor: str | None, lookback_days: int, bounds: str = "[)") -> Callable[[DataFrame], Column] | None:
    if anchor is None:
        return None
    return lambda df: lookback(df["sold_at"], column_type(df, "sold_at"), anchor, lookback_days, bounds)


def label_spikes_from_tables(t: Tables, anchor: str | None = DEFAULT_ANCHOR,
                             lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                             window_seconds: int = WINDOW_SECONDS, latest_method: str = "window",
                             null_big_amount_region: int | None = None) -> DataFrame:
    """The job over the driver's tables (sales pre-summed per user and hour before the join).

    The derived history holds one row per (client, country, month), so rows per
    key are bounded by the months and the latest row can be ranked in one pass.
    """
    t.prefetch("events", "customer", "nation", "orders")
    hourly = fixtures.hourly_sales(t, sales_window(anchor, lookback_days))
    return label_hourly(hourly, fixtures.history(t), fixtures.thresholds(t, null_big_amount_region),
                        window_seconds, latest_method, scale=fixtures.SCALE)


def run_job(t: Tables, anchor: str = DEFAULT_ANCHOR, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
            iterations: int | None = None, seed: int | None = None, keys: list | None = None):
    """The whole job: label, split 20 / 80, train the 8-20-3 network on the 20 %, score the 80 %.

    Returns (labelled rows, trained network, scored rows). The labelled rows are
    checkpointed, so labelling runs once. ``keys`` splits by key instead of at random.
    """
    from surgewatch.operators import classify

    labelled = checkpointed(label_spikes_from_tables(t, anchor, lookback_days))
    settings = classify.NetworkSettings(
        inputs=len(classify.SPIKE_FEATURES), outputs=classify.JOB_OUTPUTS, hidden=classify.JOB_HIDDEN,
        seed=seed, max_iter=iterations if iterations is not None else classify.DEFAULT_MAX_ITER)
    net, test = classify.train_on_split(labelled, "label", classify.SPIKE_FEATURES, settings, keys=keys)
    return labelled, net, net.classify(test)
