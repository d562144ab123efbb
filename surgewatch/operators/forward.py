"""A trained network as column expressions: the forward pass without Spark ML.

Every hidden neuron is ``1 / (1 + exp(-z))`` of its weighted inputs, the output layer a softmax.
A layer is one array expression over the layer before it, so the plan stays small whatever the
width, needs no vectors and no model on the executors, and can be written in any SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


@dataclass(frozen=True)
class Network:
    """``weights[l][o][i]`` and ``biases[l][o]`` of each layer; ``labels`` by output neuron.

    There may be more output neurons than labels: an output without a label is never predicted
    after training and gives a null label.
    """

    features: tuple[str, ...]
    weights: tuple
    biases: tuple
    labels: tuple[str, ...]

    @staticmethod
    def from_flat(features: Sequence[str], layers: Sequence[int], flat: Sequence[float], labels: Sequence[str]) -> Network:
        """From one list: for each layer the weights, input by input, then the biases (Spark ML's order)."""
        weights, biases, at = [], [], 0
        for n_in, n_out in zip(layers, layers[1:], strict=False):
            block = flat[at:at + n_in * n_out]
            weights.append(tuple(tuple(block[o::n_out]) for o in range(n_out)))
            biases.append(tuple(flat[at + n_in * n_out:at + (n_in + 1) * n_out]))
            at += (n_in + 1) * n_out
        if at != len(flat) or len(features) != layers[0]:
            raise ValueError(f"{len(flat)} weights and {len(features)} features do not fit the layers {list(layers)}")
        return Network(tuple(features), tuple(weights), tuple(biases), tuple(labels))

    def _sums(self, layer: int, inputs: Column) -> Column:
        neurons = F.array(*[F.struct(F.lit(float(b)).alias("b"), _array(w).alias("w")) for w, b in zip(self.weights[layer], self.biases[layer], strict=True)])
        return F.transform(neurons, lambda n: F.aggregate(F.zip_with(n["w"], inputs, lambda w, x: w * x), n["b"], lambda s, x: s + x))

    def probabilities(self) -> Column:
        """The outputs' probabilities; an array of nulls where a feature is null."""
        def onwards(layer: int, inputs: Column) -> Column:
            if layer == len(self.weights) - 1:
                shifted = let(self._sums(layer, inputs), lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
                return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda all_: F.transform(e, lambda x: x / all_)))
            return let(F.transform(self._sums(layer, inputs), lambda z: 1 / (1 + F.exp(-z))), lambda outputs: onwards(layer + 1, outputs))

        return let(F.array(*[F.col(c).cast("double") for c in self.features]), lambda inputs: onwards(0, inputs))

    def classify(self, df: DataFrame, label_out: str = "predicted_label", probability_out: str = "probabilities") -> DataFrame:
        """All columns of ``df`` plus the predicted label and the outputs' probabilities (array of double).

        The first of equal outputs wins. A null feature gives a null label.
        """
        rows = df.withColumn(probability_out, self.probabilities())
        best = F.array_position(probability_out, F.array_max(probability_out)).cast("int")
        return rows.withColumn(label_out, F.try_element_at(F.array(*[F.lit(x) for x in self.labels]), best))
