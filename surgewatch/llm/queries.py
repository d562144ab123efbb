"""The registered training-data queries: ``(spark, sf_dir) -> DataFrame`` over whole tables.

``ORACLE`` has DuckDB SQL where SQL can state the result on whole tables in
reasonable time; the other queries are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgewatch.llm import ann, decontaminate, fingerprint, html, importance, langid, lines, mixing, neardup, negatives, pii, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parameters of the mixing query and stage: domains of the sources, weights by level of the tree, the whole budget.
MIX = {
    "domains": {f"src{i}": "web" if i < 8 else "books" if i < 14 else "code" for i in range(20)},
    "weights": {"domain": {"web": 5, "books": 3, "code": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}, "origin": {"src1": 3, "src9": 2}},
    "numerator": 1, "denominator": 1, "max_epochs": 4, "seed": "mix-1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which tiles cover half of a benchmark item or more, with the item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that meet the target weights of domains, languages and sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


ORACLE["op2_mix_sources"] = mixing.oracle_sql(**MIX)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that also starts earlier are removed."""
    out = substring.dedup(table(spark, sf_dir, "documents"), length=20, start=5, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two edits (one for each 20 characters) of an earlier line are removed."""
    out = lines.dedup(table(spark, sf_dir, "documents"), max_edits=2, chars_per_edit=20, keep_text=False)
    return out.select("doc_id", "n_lines", "n_removed", "removed", "text_sha256")


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without what recurs on its host."""
    return html.main_text(table(spark, sf_dir, "pages"))


#: The key of the registered query alone; a deployment passes its own secret.
PII_KEY = b"registered-query"


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced by keyed surrogates."""
    return pii.anonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)


@query
def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and spanning links of every document: weighted Jaccard of five-word shingles of 0.8 or more."""
    return neardup.classes(table(spark, sf_dir, "documents"), shingle=5, threshold=0.8)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from ``labels`` outside the held-out third."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by family, then one-versus-one SVMs."""
    return langid.identify(table(spark, sf_dir, "documents"), max_rows=4000)


@query
def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every text and of its edited text, and how alike they are."""
    return fingerprint.digests(table(spark, sf_dir, "documents"), samples=fingerprint.SAMPLES)


ORACLE["op11_fingerprint"] = fingerprint.oracle_sql(fingerprint.SAMPLES)


#: Parameters of the importance draw: its share, the words that a drawn document needs, the buckets and the seed.
DRAW = {"numerator": 5, "denominator": 100, "min_words": 20, "buckets": 10_000, "seed": "42"}


@query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the texts of ``benchmark``."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), **DRAW)


ORACLE["op12_importance_resample"] = importance.oracle_sql(**DRAW)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels close to, but under, the score of an anchor's positives; every seventh label is moved on."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, "id % 50 = 0", positives=5, negatives=3, low=50, high=95, scale=256, id_col="vec_id", vec_col="embedding")


ORACLE["op13_hard_negatives"] = negatives.ORACLE_SQL
