import math

import pytest
from pyspark.sql import functions as F

from surgewatch.operators import classify
from surgewatch.operators.forward import Network
from surgewatch.plans import flagship
from surgewatch.sources.fixtures import Tables
from tests.conftest import SF_SMALL


def test_columns_equal_the_trained_pipeline(spark):
    rows = flagship.label_spikes_from_tables(Tables(spark, SF_SMALL), "2024-01-31T00:00:00", 90)
    for hidden in ((20,), (5, 4)):
        settings = classify.NetworkSettings(inputs=8, outputs=3, hidden=hidden, seed=5, max_iter=30)
        net = classify.train_network(rows, "label", classify.SPIKE_FEATURES, settings, evaluate=False)
        both = net.as_columns().classify(net.classify(rows).withColumnRenamed("predicted_label", "by_pipeline"))
        from pyspark.ml.functions import vector_to_array

        got = both.select("by_pipeline", "predicted_label", "probabilities", vector_to_array("probability").alias("wanted")).collect()
        assert len(got) == 951 and all(r.by_pipeline == r.predicted_label for r in got)
        assert all(math.isclose(a, b, abs_tol=1e-9) for r in got for a, b in zip(r.probabilities, r.wanted, strict=True))


def test_forward_pass_by_hand_and_nulls(spark):
    net = Network.from_flat(["x", "y"], [2, 1, 2], [1.0, -2.0, 0.5, 3.0, -1.0, 0.25, 0.0], ["a", "b"])
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0), (None, 1.0)], "x double, y double")
    got = net.classify(df).collect()
    for r in got[:2]:
        h = 1 / (1 + math.exp(-(0.5 + r.x - 2 * r.y)))
        z = [0.25 + 3 * h, -h]
        e = [math.exp(v - max(z)) for v in z]
        assert r.predicted_label == "a" and r.probabilities == pytest.approx([v / sum(e) for v in e])
    assert got[2].predicted_label is None
    with pytest.raises(ValueError):
        Network.from_flat(["x"], [2, 1], [1.0, 2.0, 3.0], ["a"])


def test_outputs_without_a_label(spark):
    net = Network.from_flat(["x"], [1, 2], [0.0, 0.0, 0.0, 5.0], ["only"])
    assert net.classify(spark.range(1).select(F.lit(1.0).alias("x"))).first().predicted_label is None
