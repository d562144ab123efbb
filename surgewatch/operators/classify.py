"""Train and apply the spike classifier (a multilayer perceptron) with Spark ML.

Pipeline: VectorAssembler -> StringIndexer (fitted on all rows given, before
the split) -> MultilayerPerceptronClassifier -> IndexToString.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgewatch.operators import forward
from surgewatch.session import broadcast_if_small, checkpointed

# The job's inputs, in order, and the network defaults.
SPIKE_FEATURES = ("last24h_amount", "daily_amount", "spike_amount", "big_spike_amount",
                  "spike_pct", "big_spike_pct", "diff", "pct")
DEFAULT_HIDDEN = (10, 6, 3)
DEFAULT_HELD_OUT_PCT = 20
DEFAULT_BLOCK_SIZE = 128
DEFAULT_MAX_ITER = 300
JOB_HIDDEN = (20,)
JOB_OUTPUTS = 3
JOB_TRAIN_SHARE = 0.2   # the job trains on 20% of the labelled rows and scores the other 80%


@dataclass(frozen=True)
class NetworkSettings:
    """Network shape and training settings; ``seed=None`` takes the current time."""

    inputs: int
    outputs: int
    hidden: tuple[int, ...] = DEFAULT_HIDDEN
    held_out_pct: int = DEFAULT_HELD_OUT_PCT
    seed: int | None = None
    block_size: int = DEFAULT_BLOCK_SIZE
    max_iter: int = DEFAULT_MAX_ITER
    resolved_seed: int = field(init=False)

    def __post_init__(self):
        if self.inputs < 1 or self.outputs < 1 or any(h < 1 for h in self.hidden):
            raise ValueError("layer sizes must be positive")
        if not 0 < self.held_out_pct < 100:
            raise ValueError("held_out_pct must lie strictly between 0 and 100")
        object.__setattr__(self, "resolved_seed",
                           self.seed if self.seed is not None else int(time.time() * 1000))

    def layers(self) -> list[int]:
        return [self.inputs, *self.hidden, self.outputs]


@dataclass
class TrainedNetwork:
    model: PipelineModel
    labels: list[str]
    accuracy: float | None

    @property
    def error_pct(self) -> float | None:
        return None if self.accuracy is None else (1.0 - self.accuracy) * 100

    def classify(self, df: DataFrame) -> DataFrame:
        """All input columns plus ``predicted_label`` (and the model's own columns)."""
        return self.model.transform(df)

    def as_columns(self) -> forward.Network:
        """The same network as column expressions: scoring without Spark ML, in any plan."""
        assembler, net = self.model.stages[0], self.model.stages[2]
        return forward.Network.from_flat(assembler.getInputCols(), list(net.getOrDefault("layers")), net.weights.toArray().tolist(), self.labels)


def split_by_key(df: DataFrame, keys, share_pct: float = 20.0, out: str = "part") -> DataFrame:
    """Portable split: ``train`` when the first md5 byte of the key is below share * 256.

    The same rows land in the same part in any engine and any partitioning;
    every row is kept. ``keys`` are column names or expressions.
    """
    bound = format(round(share_pct / 100 * 256), "02x")
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return df.withColumn(out, F.when(F.substring(F.md5(text), 1, 2) < F.lit(bound), F.lit("train"))
                         .otherwise(F.lit("test")))


def split_random(df: DataFrame, train_share: float = JOB_TRAIN_SHARE, seed: int | None = None):
    """``randomSplit([train_share, 1 - train_share], seed)`` -> (train, test).

    The rows are checkpointed first: both parts are drawn from the same written
    rows, so no row falls into both or neither.
    """
    seed = int(time.time() * 1000) if seed is None else seed
    train, test = checkpointed(df).randomSplit([train_share, 1 - train_share], seed)
    return train, test


DIGITS = 3   # hex digits of the hash that one histogram tells apart


def split_exact(df: DataFrame, keys, share: float, by: str, seed: int = 0, out: str = "part") -> DataFrame:
    """``train`` for exactly ``floor(share x rows)`` rows of each value of ``by``, ``test`` for the rest.

    The rows of a class are ordered by a seeded MD5 of their ``keys`` (column names or expressions,
    which tell rows apart), so the same rows are chosen under any partitioning and in any engine.
    The last chosen hash of each class is found by histograms: rows per first three hex digits,
    then the next three of those rows that share the cut's digits, until the cut falls between two
    digits. Each histogram has at most 4,096 rows a class. Rows with equal keys stay together, on the
    train side if the first of them belongs there. A null class is a class of its own.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    rows = df.withColumn("_hash", F.md5(text)).withColumn("_class", F.coalesce(F.col(by).cast("string"), F.lit(""))).withColumn("_none", F.col(by).isNull())
    group = ["_none", "_class"]
    cuts = checkpointed(rows.groupBy(*group).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_need")).withColumn("_cut", F.lit("")))
    for length in range(DIGITS, 32 + DIGITS, DIGITS):
        open_ = cuts.filter(F.col("_need") > 0)
        inside = rows.select(*group, "_hash").join(broadcast_if_small(open_), group).filter(F.col("_hash").startswith(F.col("_cut")))
        counts = inside.groupBy(*group, F.substring("_hash", 1, length).alias("_next"), "_need").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_next"))
        found = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        found = found.select(*group, "_next", (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n")
        cuts = checkpointed(cuts.join(found, group, "left").select(
            *group, F.coalesce("_next", "_cut").alias("_cut"), F.coalesce("_left", F.lit(0)).alias("_need"), F.coalesce("_n", F.lit(0)).alias("_n")))
        # done where the cut's rows are all chosen
        if cuts.filter(F.col("_need") < F.col("_n")).isEmpty():
            break
        cuts = cuts.drop("_n")
    cuts = cuts.select(*group, "_cut")
    chosen = (F.col("_cut") != "") & (F.substring(F.col("_hash"), F.lit(1), F.length("_cut")) <= F.col("_cut"))
    return (rows.join(broadcast_if_small(cuts), group).withColumn(out, F.when(chosen, F.lit("train")).otherwise(F.lit("test")))
            .drop("_hash", "_cut", *group))


def label_indexer(df: DataFrame, label_col: str, out: str = "label_index"):
    """Labels indexed by descending frequency (ties alphabetical), fitted on ``df``."""
    return StringIndexer(inputCol=label_col, outputCol=out).fit(df)


def train_network(df: DataFrame, label_col: str, feature_cols, settings: NetworkSettings,
                  evaluate: bool = True) -> TrainedNetwork:
    """Fit the pipeline on ``100 - held_out_pct`` % of ``df``; report accuracy on the rest.

    Raises ``ValueError`` before fitting when there are more labels than output
    neurons. Feature NULLs raise in the assembler: drop or impute them first.
    The rows are checkpointed to the shared checkpoint folder before the split
    (the indexer, both parts and a lost executor's recovery all read the same
    written rows); the training part is persisted for the iterations.
    """
    df = checkpointed(df)
    feature_cols = list(feature_cols)
    if len(feature_cols) != settings.inputs:
        raise ValueError(f"{len(feature_cols)} feature columns for {settings.inputs} input neurons")
    indexer = label_indexer(df, label_col)
    labels = list(indexer.labels)
    if len(labels) > settings.outputs:
        raise ValueError(f"{len(labels)} labels {labels} but only {settings.outputs} output neurons")
    held = settings.held_out_pct / 100
    train, test = df.randomSplit([1 - held, held], settings.resolved_seed)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="error"),
        indexer,
        MultilayerPerceptronClassifier(layers=settings.layers(), blockSize=settings.block_size,
                                       seed=settings.resolved_seed, maxIter=settings.max_iter,
                                       featuresCol="features", labelCol="label_index"),
        IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels),
    ])
    try:
        model = pipeline.fit(train)
    finally:
        train.unpersist()
    accuracy = None
    if evaluate:
        scored = model.transform(test)
        accuracy = MulticlassClassificationEvaluator(labelCol="label_index", predictionCol="prediction",
                                                     metricName="accuracy").evaluate(scored)
    return TrainedNetwork(model, labels, accuracy)


def train_on_split(labelled: DataFrame, label_col: str, feature_cols, settings: NetworkSettings,
                   train_share: float = JOB_TRAIN_SHARE, keys: list | None = None) -> tuple[TrainedNetwork, DataFrame]:
    """The job's flow: split 20 / 80, train, return the scoring part.

    The labelled rows are checkpointed before the split, so the labelling chain
    runs once. With ``keys`` the parts are those of :func:`split_by_key` (the
    same rows in any engine), else a random split.
    """
    if keys is None:
        train, test = split_random(labelled, train_share, settings.resolved_seed)
    else:
        parts = split_by_key(checkpointed(labelled), keys, 100 * train_share, "_part")
        train, test = (parts.filter(F.col("_part") == p).drop("_part") for p in ("train", "test"))
    return train_network(train, label_col, feature_cols, settings), test
