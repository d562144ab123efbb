from datetime import datetime

HOURLY_SCHEMA = "client_id bigint, country string, hour timestamp_ntz, amount double"
HISTORY_SCHEMA = "client_id bigint, country string, month string, amount double"
THRESHOLD_SCHEMA = ("country string, spike_amount double, big_spike_amount double, "
                    "spike_pct double, big_spike_pct double")


def h(day: int, hour: int) -> datetime:
    return datetime(2024, 1, day, hour)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
