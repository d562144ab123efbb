"""Edge cases of the labelling chain (hand-written fixtures)."""

from surgewatch.operators import baseline
from surgewatch.plans import flagship
from tests.helpers import HISTORY_SCHEMA, HOURLY_SCHEMA, THRESHOLD_SCHEMA, h, rows


def run(spark, hourly, history, thresholds, method="join"):
    return flagship.label_hourly(spark.createDataFrame(hourly, HOURLY_SCHEMA),
                                 spark.createDataFrame(history, HISTORY_SCHEMA),
                                 spark.createDataFrame(thresholds, THRESHOLD_SCHEMA), latest_method=method)


THR = [("A", 10.0, 100.0, 20.0, 200.0)]


def test_label_classes_and_strict_boundaries(spark):
    # daily = 300 / 30 = 10
    hourly = [(1, "A", h(1, 0), 15.0),    # diff 5  -> no spike (5 < 10 fails)
              (2, "A", h(1, 0), 20.0),    # diff 10 == threshold -> strict: no spike
              (3, "A", h(1, 0), 21.0),    # diff 11, pct 110 -> spike
              (4, "A", h(1, 0), 200.0)]   # diff 190 < 100? yes > ; pct 1900 > 200 -> big spike
    history = [(c, "A", "2024-01", 300.0) for c in (1, 2, 3, 4)]
    out = run(spark, hourly, history, THR)
    got = {r.client_id: r.label for r in out.collect()}
    assert got == {1: "NO_SPIKE", 2: "NO_SPIKE", 3: "SPIKE", 4: "BIG_SPIKE"}


def test_latest_month_only_and_duplicates_double(spark):
    hourly = [(1, "A", h(1, 0), 50.0), (2, "A", h(1, 0), 50.0)]
    history = [(1, "A", "2023-12", 3000.0), (1, "A", "2024-01", 300.0),
               (2, "A", "2024-01", 300.0), (2, "A", "2024-01", 300.0)]   # duplicate latest row
    for method in ("join", "window"):
        out = run(spark, hourly, history, THR, method)
        got = rows(out, "client_id", "daily_amount")
        assert got == [(1, 10.0), (2, 10.0), (2, 10.0)]


def test_zero_missing_and_null_keys_drop_rows(spark):
    hourly = [(1, "A", h(1, 0), 50.0), (2, "A", h(1, 0), 50.0), (3, "B", h(1, 0), 50.0),
              (None, "A", h(1, 0), 50.0)]
    history = [(1, "A", "2024-01", 0.0),          # zero baseline -> pct NULL -> dropped
               (3, "B", "2024-01", 300.0),        # no thresholds for B -> dropped
               (None, "A", "2024-01", 300.0)]     # NULL key never matches
    assert run(spark, hourly, history, THR).count() == 0


def test_negative_baseline_flips_sign(spark):
    out = run(spark, [(1, "A", h(1, 0), 5.0)], [(1, "A", "2024-01", -300.0)], THR).first()
    assert out.diff == 15.0 and out.pct == -150.0 and out.label == "NO_SPIKE"


def test_duplicate_threshold_country_doubles(spark):
    out = run(spark, [(1, "A", h(1, 0), 50.0)], [(1, "A", "2024-01", 300.0)], THR + THR)
    assert out.count() == 2


def test_big_spike_without_spike_and_null_threshold(spark):
    thr = [("A", 1000.0, 5.0, 1000.0, 5.0),   # big thresholds below the small ones
           ("B", None, None, 20.0, None)]      # NULL thresholds
    hourly = [(1, "A", h(1, 0), 50.0), (2, "B", h(1, 0), 50.0)]
    history = [(1, "A", "2024-01", 300.0), (2, "B", "2024-01", 300.0)]
    got = {r.client_id: (r.spike, r.big_spike, r.label) for r in run(spark, hourly, history, thr).collect()}
    assert got[1] == (False, True, "BIG_SPIKE")
    assert got[2][2] == "NO_SPIKE" and got[2][0] is None   # row stays, flag is NULL


def test_trailing_total_feeds_metrics(spark):
    hourly = [(1, "A", h(1, 0), 10.0), (1, "A", h(1, 12), 10.0), (1, "A", h(2, 0), 10.0), (1, "A", h(2, 1), 10.0)]
    out = run(spark, hourly, [(1, "A", "2024-01", 300.0)], THR)
    got = rows(out, "hour", "last24h_amount")
    assert got == [(h(1, 0), 10.0), (h(1, 12), 20.0), (h(2, 0), 30.0), (h(2, 1), 30.0)]


def test_latest_methods_agree_on_history(spark):
    from surgewatch.sources.fixtures import Tables, history
    from tests.conftest import SF_SMALL

    hist = history(Tables(spark, SF_SMALL))
    cols = ("client_id", "country", "month", "amount")
    assert rows(baseline.latest_rows(hist, method="join"), *cols) == \
        rows(baseline.latest_rows(hist, method="window"), *cols)


def test_duplicate_keys(spark):
    df = spark.createDataFrame(THR + THR + [("B", 1.0, 2.0, 3.0, 4.0)], THRESHOLD_SCHEMA)
    assert rows(baseline.duplicate_keys(df, ["country"]), "country", "count") == [("A", 2)]


def test_flagship_unchanged_by_partitioning(spark):
    from surgewatch.sources import fixtures
    from surgewatch.sources.fixtures import Tables
    from tests.conftest import SF_SMALL

    t = Tables(spark, SF_SMALL)
    sales, hist, thr = fixtures.sales(t), fixtures.history(t), fixtures.thresholds(t)
    cols = ("client_id", "country", "hour", "amount", "last24h_amount", "pct", "label")
    base = rows(flagship.label_spikes(sales, hist, thr, anchor=None), *cols)
    for n in (1, 7):
        again = flagship.label_spikes(sales.repartition(n), hist.repartition(n), thr.repartition(n), anchor=None)
        assert rows(again, *cols) == base
    assert len(base) == 951


def test_co_partition_option_same_result(spark):
    from surgewatch.sources import fixtures
    from surgewatch.sources.fixtures import Tables
    from tests.conftest import SF_SMALL

    t = Tables(spark, SF_SMALL)
    sales, hist, thr = fixtures.sales(t), fixtures.history(t), fixtures.thresholds(t)
    cols = ("client_id", "country", "hour", "amount", "last24h_amount", "pct", "label")
    a = flagship.label_spikes(sales, hist, thr, anchor=None)
    b = flagship.label_spikes(sales, hist, thr, anchor=None, co_partition=True)
    assert rows(a, *cols) == rows(b, *cols)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(client_id") >= 1


def test_iso_string_timestamps_same_labels(spark):
    """Sales whose time is ISO text (as a document store returns it) label like typed timestamps."""
    from pyspark.sql import functions as F

    from surgewatch.sources import fixtures
    from surgewatch.sources.fixtures import Tables
    from tests.conftest import SF_SMALL

    t = Tables(spark, SF_SMALL)
    sales, hist, thr = fixtures.sales(t), fixtures.history(t), fixtures.thresholds(t)
    iso = sales.withColumn("sold_at", F.date_format("sold_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    cols = ("client_id", "country", "amount", "last24h_amount", "pct", "label")
    typed = flagship.label_spikes(sales, hist, thr, anchor="2024-01-31T00:00:00", lookback_days=90)
    text = flagship.label_spikes(iso, hist, thr, anchor="2024-01-31T00:00:00", lookback_days=90)
    assert rows(text, *cols) == rows(typed, *cols)
    assert text.schema["hour"].dataType.typeName() == "timestamp"
