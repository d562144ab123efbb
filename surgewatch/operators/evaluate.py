"""Evaluation of (actual, predicted) label pairs, each in one aggregation pass.

Rates are NULL (not NaN) when a class is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pct(part: str, whole: str):
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")) * F.lit(100)


def accuracy(df: DataFrame, actual: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """One row: correct, total, accuracy_pct."""
    out = df.agg(F.count_if(F.col(actual) == F.col(predicted)).alias("correct"),
                 F.count(F.lit(1)).alias("total"))
    return out.select("correct", "total", _pct("correct", "total").alias("accuracy_pct"))


def class_share(df: DataFrame, actual: str = "label") -> DataFrame:
    """Per class: count, total, share_pct (the total comes from the per-class counts)."""
    counts = df.groupBy(F.col(actual).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # The window spans the per-class rows only (one per label value).
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.select("label", "count", total.alias("total")).withColumn("share_pct", _pct("count", "total"))


def recall(df: DataFrame, actual: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Per actual class: total, correct, recall_pct."""
    out = df.groupBy(F.col(actual).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(actual) == F.col(predicted)).alias("correct"))
    return out.withColumn("recall_pct", _pct("correct", "total"))


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """label, count, label_index: StringIndexer's order (count desc, then label) as data."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("count").desc(), F.col("label").asc())
    return counts.withColumn("label_index", (F.row_number().over(order) - 1).cast("double"))


def report(df: DataFrame, actual: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """The job's printed report as rows, one per actual class, in one aggregation.

    label, count, correct, total, share_pct, recall_pct, accuracy_pct (the last
    is the same on every row). The window spans the per-class rows only.
    """
    per = df.groupBy(F.col(actual).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col(actual) == F.col(predicted)).alias("correct"))
    everything = Window.partitionBy(F.lit(0))
    return (per.withColumn("total", F.sum("count").over(everything))
            .withColumn("_right", F.sum("correct").over(everything))
            .withColumn("share_pct", _pct("count", "total"))
            .withColumn("recall_pct", _pct("correct", "count"))
            .withColumn("accuracy_pct", _pct("_right", "total"))
            .drop("_right"))
