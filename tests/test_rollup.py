from datetime import datetime, timedelta

from pyspark.sql import functions as F

from surgewatch.operators import rollup
from tests.helpers import HOURLY_SCHEMA, h, rows


def test_hourly_sums_add_up(spark):
    data = [(1, "A", datetime(2024, 1, 1, 0, m), 1.10) for m in range(0, 60, 7)]
    data += [(1, "A", datetime(2024, 1, 1, 1, 5), 2.25), (2, "B", datetime(2024, 1, 1, 0, 1), 0.01)]
    sales = spark.createDataFrame(data, "client_id bigint, country string, sold_at timestamp_ntz, amount double")
    out = rollup.hourly_sales(sales)
    got = rows(out, "client_id", "country", "hour", "amount")
    assert got == [(1, "A", h(1, 0), 9.9), (1, "A", h(1, 1), 2.25), (2, "B", h(1, 0), 0.01)]
    total = out.agg(F.sum("amount")).first()[0]
    assert round(total, 2) == round(sum(r[3] for r in data), 2)


def test_trailing_window_covers_25_buckets(spark):
    start = datetime(2024, 1, 1)
    data = [(1, "A", start + timedelta(hours=i), 1.0) for i in range(72)]
    out = rollup.trailing_sum(spark.createDataFrame(data, HOURLY_SCHEMA))
    by_hour = {r.hour: r.last24h_amount for r in out.collect()}
    assert by_hour[start] == 1.0
    assert by_hour[start + timedelta(hours=23)] == 24.0
    assert by_hour[start + timedelta(hours=48)] == 25.0   # both ends included


def test_trailing_window_gaps(spark):
    base = datetime(2024, 1, 1, 0)
    data = [(1, "A", base, 10.0), (1, "A", base + timedelta(hours=23), 1.0),
            (2, "A", base, 10.0), (2, "A", base + timedelta(hours=24), 1.0),
            (3, "A", base, 10.0), (3, "A", base + timedelta(hours=25), 1.0)]
    out = rollup.trailing_sum(spark.createDataFrame(data, HOURLY_SCHEMA))
    last = {r.client_id: r.last24h_amount for r in out.collect() if r.hour != base}
    assert last == {1: 11.0, 2: 11.0, 3: 1.0}


def test_trailing_sum_at_least_own_bucket_and_partition_free(spark):
    data = [(c, "X", datetime(2024, 1, 1) + timedelta(hours=(c * 7 + i * 5) % 90), float(i % 9) + 0.5)
            for c in range(5) for i in range(40)]
    df = rollup.hourly_sales(spark.createDataFrame(
        data, "client_id bigint, country string, sold_at timestamp_ntz, amount double"))
    a = rollup.trailing_sum(df)
    assert all(r.last24h_amount >= r.amount for r in a.collect())
    cols = ("client_id", "hour", "amount", "last24h_amount")
    assert rows(a, *cols) == rows(rollup.trailing_sum(df.repartition(1)), *cols) \
        == rows(rollup.trailing_sum(df.repartition(7)), *cols)


def test_client_buckets_order_and_size(spark):
    data = [(1, 1.0), (1, 2.0), (2, 5.0), (3, 1.0), (3, 1.0), (4, 0.5)]
    df = spark.createDataFrame(data, "client_id bigint, amount double")
    out = rollup.client_buckets(df, size=3).collect()
    assert [(r.client_id, r.doc_count, r.amount) for r in out] == [(1, 2, 3.0), (3, 2, 2.0), (2, 1, 5.0)]


def test_grouped_count_keep_and_summary(spark):
    df = spark.createDataFrame([(1, "A", "2024-01"), (1, "A", "2024-01"), (1, "B", "2024-01"), (2, "A", "2024-02")],
                               "agent_code bigint, country_code string, month string")
    out = rollup.grouped_count(df, ["agent_code", "country_code", "month"], keep=["agent_code"])
    assert out.columns == ["agent_code", "count"]
    assert rows(out, "agent_code", "count") == [(1, 1), (1, 2), (2, 1)]
    s = rollup.summary(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), ["x"]).first()
    assert (s.field, s["count"], s.mean, s.stddev, s["min"], s["max"]) == ("x", 3, 2.0, 1.0, 1.0, 3.0)


def test_top_by_count_equals_plain_top_k(spark):
    import random

    rnd = random.Random(5)
    data = [(k, rnd.choice([1, 1, 1, 2, 2, 3, 5, 8])) for k in range(500)]
    df = spark.createDataFrame(data, "client_id bigint, doc_count bigint").repartition(7)
    for size in (1, 10, 137, 499, 500, 900):
        want = df.orderBy(F.col("doc_count").desc(), F.col("client_id")).limit(size).collect()
        assert rollup.top_by_count(df, size, "client_id").collect() == want


def test_trailing_spans_equal_the_whole_window(spark):
    import random

    rnd = random.Random(3)
    start = datetime(2023, 12, 30)
    data = [(c, k, start + timedelta(hours=rnd.randrange(400)), rnd.randrange(-500, 9000) / 100) for c in (1, 2, None) for k in ("A", None) for _ in range(150)]
    data += [(1, "A", None, 3.25)]
    hourly = spark.createDataFrame(list({r[:3]: r for r in data}.values()), HOURLY_SCHEMA)
    for seconds in (0, 3600, 86400, 10 * 86400):
        want = rows_of_totals(rollup.trailing_sum(hourly, seconds=seconds, scale=2))
        for span in (3600, 5 * 3600, 86400, 365 * 86400):
            split = rollup.trailing_sum(hourly, seconds=seconds, scale=2, span_seconds=span)
            assert rows_of_totals(split) == want and split.columns == [*hourly.columns, "last24h_amount"]


def rows_of_totals(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_long_history_is_in_many_groups(spark):
    hourly = spark.range(24 * 365).selectExpr("id % 1 as client_id", "cast(id % 1 as string) as country", "timestamp_ntz '2023-01-01' + make_dt_interval(0, id) as hour", "1.0D as amount")
    out = rollup.trailing_sum(hourly, scale=2, span_seconds=7 * 86400)
    assert out.filter("last24h_amount = 25").count() == 24 * 365 - 24
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(client_id" in plan and "_span" in plan.split("hashpartitioning(client_id")[1][:80]


def test_token_buckets(spark):
    data = [("New York", 1.5), ("new  NEW york-city", 2.25), (None, 9.0), ("", 1.0), ("Österreich 7", 0.1), ("Österreich 7", 0.2)]
    df = spark.createDataFrame(data, "country string, amount double")
    got = {r.key: (r.doc_count, r.amount) for r in rollup.token_buckets(df, "country", "amount", scale=2).collect()}
    assert got == {"new": (2, 3.75), "york": (2, 3.75), "city": (1, 2.25), "österreich": (2, 0.3), "7": (2, 0.3)}
    assert [r.key for r in rollup.token_buckets(df, "country", "amount", size=2, scale=2).collect()] == ["7", "new"]


def test_heavy_buckets_equal_the_exact_pass(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    keys = [7] * 3000 + [None] * 800 + [k for k in range(100, 110) for _ in range(400)] + [rnd.randrange(10**6) for _ in range(3000)]
    rnd.shuffle(keys)
    df = spark.createDataFrame([(k, i / 100) for i, k in enumerate(keys)], "client_id bigint, amount double").repartition(4)
    fallbacks = []
    real = rollup.client_buckets
    monkeypatch.setattr(rollup, "client_buckets", lambda *a, **k: (fallbacks.append(1), real(*a, **k))[1])
    for size, tracked, proven in ((1, 1024, True), (12, 1024, True), (30, 256, False), (5, 1 << 14, True)):
        got = [tuple(r) for r in rollup.heavy_buckets(df, size=size, tracked=tracked, scale=2).collect()]
        assert got == [tuple(r) for r in real(df, size=size, scale=2).collect()] and len(got) == size
        assert bool(fallbacks) == (not proven)
        fallbacks.clear()
    few = df.filter("client_id between 100 and 109")
    assert len(rollup.heavy_buckets(few, size=50, tracked=64, scale=2).collect()) == 10 and not fallbacks
    assert rollup.heavy_buckets(df.limit(0), size=5).collect() == []


def test_heavy_buckets_fetch_numbers_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    fetched, real = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda self: (fetched.append(self.columns), real(self))[1])
    df = spark.createDataFrame([(k % 9, k / 100) for k in range(300)], "client_id bigint, amount double")
    assert len(rollup.heavy_buckets(df, size=5, tracked=64, scale=2).collect()) == 5
    assert fetched and all("items" not in columns for columns in fetched)
