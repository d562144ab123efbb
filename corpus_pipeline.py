"""The training-data pipeline over ``documents``: five stages, each written and read again.

1. ``language``: documents without a language (no text, no letter) go.
2. ``lines``: repeated and near-repeated lines go; a document of which every line went, goes.
3. ``near_duplicates``: one document of each class of near-duplicates stays.
4. ``decontaminate``: documents that hold half of a benchmark item or more go.
5. ``mix``: documents and epochs that meet the target weights, with their tokens.

Each stage works on all rows that the one before it kept. All but the last
return the columns of their input; ``n_chars`` follows the text where there is
such a column. The last adds the leaf, the epoch and the tokens. A stage gives
an empty table for an empty table; the operators' docstrings say what nulls,
ties, repeated rows and clashing names do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgewatch.llm import decontaminate, langid, lines, mixing, neardup
from surgewatch.llm.exchange import saved
from surgewatch.llm.queries import MIX


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    out = lines.dedup(docs, max_edits=2, chars_per_edit=20, rest=rest, own_prefix="_own_")
    out = out.filter("_own_n_removed = 0 or length(_own_text) > 0").withColumnRenamed("_own_text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_own_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, **MIX, carry=["text"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontamination),
    ("mix", mix),
]

#: The line and near-duplicate joins and the tiling have no practical SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
