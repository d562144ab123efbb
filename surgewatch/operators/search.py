"""Document-style searches: match any term, first n, simple filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_any(df: DataFrame, terms: Mapping[str, object], order_key: str, size: int = 20) -> DataFrame:
    """Rows matching at least one ``column == value`` term, best first.

    ``score`` counts the matched terms (a stand-in for a store's relevance
    score); ties go by ``order_key``. The top ``size`` is the feature.
    """
    score = wanted = None
    for col, value in terms.items():
        equal = F.col(col) == F.lit(value)
        hit = F.coalesce(equal.cast("int"), F.lit(0))
        score = hit if score is None else score + hit
        wanted = equal if wanted is None else wanted | equal
    # the plain predicate first: the scan can take it, a computed score it cannot
    return (df.filter(wanted).withColumn("score", score.cast("bigint"))
            .orderBy(F.col("score").desc(), F.col(order_key).asc()).limit(size))


def first_n(df: DataFrame, order_key: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows in ``order_key`` order (a store returns any n; this is fixed)."""
    return df.orderBy(F.col(order_key).asc()).limit(n)


def where_equal(df: DataFrame, equalities: Mapping[str, object]) -> DataFrame:
    """Chained equality filters on (possibly dotted) columns; Catalyst merges them."""
    for col, value in equalities.items():
        df = df.filter(F.col(col) == F.lit(value))
    return df


def where_greater(df: DataFrame, col: str, limit) -> DataFrame:
    return df.filter(F.col(col) > F.lit(limit))
