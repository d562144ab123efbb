import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from surgewatch.operators import stats

# The eight literal rows of the chi-square example and its measured result.
CHI_ROWS = [(1.0, [0.5, 10.0, 7.0]), (1.0, [1.5, 20.0, 7.0]), (1.0, [1.5, 30.0, 7.0]), (0.0, [3.5, 30.0, 7.1]),
            (0.0, [4.5, 40.0, 7.1]), (1.0, [1.5, 40.0, 7.0]), (1.0, [1.5, 40.0, 7.0]), (1.0, [1.5, 40.0, 7.0])]
P_VALUES = [0.04601170568923152, 0.7212333746277605, 0.004677734981047288]
DEGREES = [3, 3, 1]
STATISTICS = [8.0, 1.3333333333333333, 8.0]


def test_chi_square_literal_rows(spark):
    schema = T.StructType([T.StructField("label", T.DoubleType(), False),
                           T.StructField("features", VectorUDT(), False)])
    df = spark.createDataFrame([(lab, Vectors.dense(v)) for lab, v in CHI_ROWS], schema)
    out = stats.chi_square(df).orderBy("feature_index").collect()
    assert [r.degrees_of_freedom for r in out] == DEGREES
    assert [r.p_value for r in out] == pytest.approx(P_VALUES, rel=1e-12)
    assert [r.statistic for r in out] == pytest.approx(STATISTICS, rel=1e-12)
