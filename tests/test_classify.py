import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from surgewatch.operators import classify, evaluate
from surgewatch.plans import flagship
from surgewatch.sources.fixtures import Tables
from tests.conftest import SF_SMALL


def test_layers_and_defaults():
    s = classify.NetworkSettings(inputs=8, outputs=3, hidden=(20,), seed=1)
    assert s.layers() == [8, 20, 3]
    d = classify.NetworkSettings(inputs=4, outputs=3)
    assert d.layers() == [4, 10, 6, 3, 3] and d.max_iter == 300 and d.block_size == 128 and d.held_out_pct == 20
    with pytest.raises(ValueError):
        classify.NetworkSettings(inputs=0, outputs=3)


def _labelled(spark):
    return flagship.label_spikes_from_tables(Tables(spark, SF_SMALL), "2024-01-31T00:00:00", 90)


def test_guard_more_labels_than_outputs(spark):
    df = spark.createDataFrame([(float(i), "abcd"[i % 4]) for i in range(20)], "x double, label string")
    settings = classify.NetworkSettings(inputs=1, outputs=3, hidden=(2,), seed=1, max_iter=5)
    with pytest.raises(ValueError, match="4 labels"):
        classify.train_network(df, "label", ["x"], settings)


def test_split_by_key_disjoint_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    parts = classify.split_by_key(df, ["k"], 20.0)
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 2000 and 300 < counts["train"] < 500
    again = classify.split_by_key(df.repartition(7), ["k"], 20.0)
    assert parts.subtract(again).count() == 0


def test_label_index_matches_string_indexer(spark):
    df = _labelled(spark)
    ours = [r.label for r in evaluate.label_index(df).orderBy("label_index").collect()]
    assert ours == list(StringIndexer(inputCol="label", outputCol="i").fit(df).labels)


def test_training_small_and_repeatable(spark):
    df = _labelled(spark).orderBy("client_id", "country", "hour").coalesce(1)
    settings = classify.NetworkSettings(inputs=8, outputs=3, hidden=(20,), seed=7, max_iter=40)
    net = classify.train_network(df, "label", classify.SPIKE_FEATURES, settings)
    assert set(net.labels) <= {"NO_SPIKE", "SPIKE", "BIG_SPIKE"}
    assert 0.0 <= net.accuracy <= 1.0 and net.error_pct == pytest.approx((1 - net.accuracy) * 100)
    scored = net.classify(df)
    assert scored.filter(~F.col("predicted_label").isin(*net.labels)).count() == 0
    majority = df.groupBy("label").count().agg(F.max("count")).first()[0] / df.count()
    acc = evaluate.accuracy(scored).first().accuracy_pct / 100
    assert acc >= majority - 0.05
    net2 = classify.train_network(df, "label", classify.SPIKE_FEATURES, settings)
    a = [r.predicted_label for r in net.classify(df).select("predicted_label").collect()]
    b = [r.predicted_label for r in net2.classify(df).select("predicted_label").collect()]
    assert a == b


def test_evaluation(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", None)], "label string, predicted_label string")
    acc = evaluate.accuracy(df).first()
    assert (acc.correct, acc.total, acc.accuracy_pct) == (2, 4, 50.0)
    share = {r.label: (r["count"], r.total, r.share_pct) for r in evaluate.class_share(df).collect()}
    assert share == {"A": (2, 4, 50.0), "B": (1, 4, 25.0), "C": (1, 4, 25.0)}
    rec = {r.label: (r.total, r.correct, r.recall_pct) for r in evaluate.recall(df).collect()}
    assert rec == {"A": (2, 1, 50.0), "B": (1, 1, 100.0), "C": (1, 0, 0.0)}


def test_report(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", None)], "label string, predicted_label string")
    rep = {r.label: (r["count"], r.correct, r.total, r.share_pct, r.recall_pct, r.accuracy_pct)
           for r in evaluate.report(df).collect()}
    assert rep == {"A": (2, 1, 4, 50.0, 50.0, 50.0), "B": (1, 1, 4, 25.0, 100.0, 50.0),
                   "C": (1, 0, 4, 25.0, 0.0, 50.0)}


def test_job_command_line(spark, tmp_dir, capsys):
    from surgewatch.plans import job

    job.main([SF_SMALL, f"{tmp_dir}/out", "2024-01-31T00:00:00", "--iterations", "10", "--seed", "3"])
    report = spark.read.parquet(f"{tmp_dir}/out/report")
    assert set(report.columns) >= {"label", "count", "correct", "share_pct", "recall_pct", "accuracy_pct"}
    labelled = spark.read.parquet(f"{tmp_dir}/out/labelled").count()
    scored = spark.read.parquet(f"{tmp_dir}/out/scored").count()
    assert labelled == 951 and 0 < scored < labelled
    assert report.agg(F.sum("count")).first()[0] == scored
    assert "training error" in capsys.readouterr().out


def test_split_exact_shares_and_layouts(spark):
    import hashlib

    rows = [(k, "abc"[k % 3] if k % 17 else None) for k in range(1000)] + [(5000, "single"), (5001, "pair"), (5002, "pair")]
    df = spark.createDataFrame(rows, "k bigint, label string")
    for share in (0.0, 0.2, 0.5, 1.0):
        got = {r.k: r.part for r in classify.split_exact(df, ["k"], share, "label", 7).collect()}
        want = {}
        for label in {y for _, y in rows}:
            order = sorted((k for k, y in rows if y == label), key=lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest())
            n = int(len(order) * share)
            want |= {k: "train" if i < n else "test" for i, k in enumerate(order)}
        assert got == want
        other = {r.k: r.part for r in classify.split_exact(df.repartition(7), ["k"], share, "label", 7).collect()}
        assert other == got
    assert classify.split_exact(df.limit(0), ["k"], 0.2, "label").collect() == []
    same = spark.createDataFrame([(1, "a")] * 10, "k bigint, label string")   # rows of one key stay together
    assert {r.part for r in classify.split_exact(same, ["k"], 0.3, "label").collect()} == {"train"}
    assert classify.split_exact(df, ["k"], 0.2, "label").columns == ["k", "label", "part"]
