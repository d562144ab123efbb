"""SQL over a DataFrame registered under a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_on(spark: SparkSession, df: DataFrame, name: str, sql: str) -> DataFrame:
    """Register ``df`` as temp view ``name`` and run ``sql`` on it.

    The query runs in Spark (the database, if any, only serves the scan's
    columns and pushed filters). The view lives as long as the session; use
    :func:`sql_with` to leave none behind.
    """
    df.createOrReplaceTempView(name)
    return spark.sql(sql)


def sql_with(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL whose ``{name}`` placeholders refer to the given frames (no view is left)."""
    return spark.sql(sql, **frames)
