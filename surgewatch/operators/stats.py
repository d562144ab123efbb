"""Chi-square independence test of each feature against the label (Spark ML)."""

from __future__ import annotations

from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chi_square(df: DataFrame, features: str = "features", label: str = "label",
               digits: int | None = None) -> DataFrame:
    """One row per feature: feature_index, p_value, degrees_of_freedom, statistic.

    Spark ML counts (feature, value, label) triples with map-side combining;
    each feature's contingency table is bounded by Spark's category limit
    (a feature with more distinct values raises instead of growing).
    """
    out = ChiSquareTest.test(df, features, label, flatten=True)
    stat, p_value = F.col("statistic"), F.col("pValue")
    if digits is not None:
        stat, p_value = F.round(stat, digits), F.round(p_value, digits)
    return out.select(F.col("featureIndex").alias("feature_index"), p_value.alias("p_value"),
                      F.col("degreesOfFreedom").cast("bigint").alias("degrees_of_freedom"), stat.alias("statistic"))
