"""Property tests against brute-force Python on small random inputs."""

from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from surgewatch.operators import baseline, rollup
from tests.helpers import HISTORY_SCHEMA

BASE = datetime(2024, 1, 1)

sale = st.tuples(st.integers(1, 3), st.sampled_from(["A", "B"]), st.integers(0, 72 * 60 - 1),
                 st.integers(-5000, 50000))
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def totals(hourly):
    return {(r.client_id, r.country, r.hour): (r.amount, r.last24h_amount) for r in hourly.collect()}


@SETTINGS
@given(st.lists(sale, min_size=1, max_size=60))
def test_hourly_and_trailing_match_brute_force(spark, rows):
    data = [(c, k, BASE + timedelta(minutes=m), cents / 100) for c, k, m, cents in rows]
    schema = "client_id bigint, country string, sold_at timestamp_ntz, amount {}"
    cents = defaultdict(int)
    for c, k, m, v in rows:
        cents[(c, k, BASE + timedelta(hours=m // 60))] += v
    want = {}
    for (c, k, h), v in cents.items():
        total = sum(x for (c2, k2, h2), x in cents.items()
                    if (c2, k2) == (c, k) and h - timedelta(hours=24) <= h2 <= h)
        want[(c, k, h)] = (v, total)
    # exact where the decimals are stated, and for decimals
    doubles = spark.createDataFrame(data, schema.format("double"))
    for span in (None, 36 * 3600):
        got = totals(rollup.trailing_sum(rollup.hourly_sales(doubles, scale=2), scale=2, span_seconds=span))
        assert got == {key: (v / 100, total / 100) for key, (v, total) in want.items()}
    decimals = spark.createDataFrame([(*r[:3], Decimal(v) / 100) for r, (*_, v) in zip(data, rows, strict=True)], schema.format("decimal(12,2)"))
    assert totals(rollup.trailing_sum(rollup.hourly_sales(decimals))) == {key: (Decimal(v) / 100, Decimal(total) / 100) for key, (v, total) in want.items()}
    # doubles without a scale are added as they come: at most 60 roundings of amounts up to 500
    got = totals(rollup.trailing_sum(rollup.hourly_sales(doubles)))
    assert got.keys() == want.keys()
    assert all(abs(a - v / 100) < 1e-9 and abs(b - total / 100) < 1e-9 for key, (v, total) in want.items() for a, b in [got[key]])


month = st.sampled_from(["2023-11", "2023-12", "2024-01", None])


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["A", None]), month,
                          st.integers(0, 9)), min_size=1, max_size=25))
def test_latest_rows_match_brute_force(spark, rows):
    data = [(c, k, m, float(a)) for c, k, m, a in rows]
    hist = spark.createDataFrame(data, HISTORY_SCHEMA)
    latest = {}
    for c, k, m, _ in data:
        if c is not None and k is not None and m is not None:
            latest[(c, k)] = max(latest.get((c, k), m), m)
    want = sorted(r for r in data if r[0] is not None and r[1] is not None and r[2] is not None
                  and r[2] == latest[(r[0], r[1])])
    for method in ("join", "window"):
        got = sorted(tuple(r) for r in baseline.latest_rows(hist, method=method)
                     .select("client_id", "country", "month", "amount").collect())
        assert got == want


@SETTINGS
@given(st.lists(st.integers(1, 6), min_size=1, max_size=80), st.integers(1, 100))
def test_top_by_count_matches_ordered_limit(spark, counts, size):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(counts)), "client_id bigint, doc_count bigint").repartition(3)
    want = [tuple(r) for r in df.orderBy(F.col("doc_count").desc(), "client_id").limit(size).collect()]
    got = [tuple(r) for r in rollup.top_by_count(df, size, "client_id").collect()]
    assert got == want
