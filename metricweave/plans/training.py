"""Training in passes, with the cost of every step.

A step is one aggregation: executors sum the gradient of the training rows and the
squared errors of both halves, and the driver moves as many numbers as the model has
weights. The rows are cut down to features, label and half, dealt into batches by a
hash of their key and written once, one folder per batch, so a step reads its batch
alone.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.functions.numeric import relu
from metricweave.operators.sampling import TEST, TRAIN, split_half
from metricweave.operators.scaling import scale_by_std
from metricweave.session import scratch_path

# Decay of the first and second moment, and what keeps a division from zero.
FIRST_DECAY, SECOND_DECAY, TINY = 0.9, 0.999, 1e-8
# Rate, passes, and the share of rows whose unit stays on, per layer.
RATE, PASSES, KEEP = 0.008, 50, (0.8, 0.5, 0.5)
# Fixed value: spread of the first layer's starting weights.
SPREAD = 0.08
HISTORY = "step bigint, half string, cost double"


@dataclass(frozen=True)
class ReluChain:
    """Layers of one unit each: relu(x·w + b), then relu(a·f + b) of the layer before."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    factors: tuple[float, ...]
    biases: tuple[float, ...]

    def __post_init__(self):
        if len(self.weights) != len(self.features) or len(self.factors) + 1 != len(self.biases):
            raise ValueError("one weight per feature, one factor per layer after the first, one bias per layer")

    @property
    def numbers(self) -> list[float]:
        return [*self.weights, *self.factors, *self.biases]

    def moved(self, numbers: Sequence[float]) -> ReluChain:
        width, depth = len(self.weights), len(self.biases)
        return replace(
            self,
            weights=tuple(numbers[:width]),
            factors=tuple(numbers[width : width + depth - 1]),
            biases=tuple(numbers[width + depth - 1 :]),
        )

    def sums(self) -> Column:
        """Input of the first unit; null where a feature is null."""
        total = F.lit(self.biases[0])
        for name, weight in zip(self.features, self.weights):
            total = total + F.col(name).cast("double") * F.lit(weight)
        return total

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = df.withColumn(name, relu(self.sums()))
        for factor, bias in zip(self.factors, self.biases[1:]):
            out = out.withColumn(name, relu(F.col(name) * F.lit(factor) + F.lit(bias)))
        return out


def starting_chain(features: Sequence[str], depth: int = 1, seed: int = 0) -> ReluChain:
    """Small random weights below two spreads, factors of one, and a bias of one on the last layer."""
    draw = random.Random(seed)
    weights = []
    while len(weights) < len(features):
        weight = draw.gauss(0.0, SPREAD)
        if abs(weight) < 2 * SPREAD:
            weights.append(weight)
    return ReluChain(tuple(features), tuple(weights), (1.0,) * (depth - 1), (0.0,) * (depth - 1) + (1.0,))


def deal_batches(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], half: str, batches: int) -> DataFrame:
    """Features as doubles, ``_label``, ``half`` and a hash per row, written in one folder per batch.

    Rows without a label or with a missing feature cannot be trained on and are left out.
    """
    drawn = F.xxhash64(*[F.col(k) for k in key])
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("double").alias("_label"),
        F.col(half).alias("half"),
        drawn.alias("_drawn"),
        F.pmod(drawn, F.lit(batches)).cast("int").alias("_batch"),
    ).dropna(subset=[*features, "_label"])
    path = scratch_path(df.sparkSession, "batches")
    rows.write.partitionBy("_batch").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _stays_on(keep: float, layer: int, step: int) -> Column:
    """Zero for units that are off in this step, else one over the kept share; the same when a task runs again."""
    share = F.pmod(F.xxhash64("_drawn", F.lit(step), F.lit(layer)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.when(share < keep, 1.0 / keep).otherwise(0.0)


def step_sums(batch: DataFrame, chain: ReluChain, step: int, keep: Sequence[float] | None) -> tuple[list[float], dict[str, float | None]]:
    """Gradient of the training cost and the cost of each half, from one aggregation.

    Costs are half the mean squared error with all units on; a half without rows has none.
    """
    depth, is_train = len(chain.biases), F.col("half") == TRAIN
    out = chain.transform(batch, "_told").withColumn("_in0", chain.sums())
    for k in range(depth):
        on = F.lit(1.0) if keep is None else _stays_on(keep[k], k, step)
        out = out.withColumn(f"_on{k}", F.when(F.col(f"_in{k}") > 0, on).otherwise(0.0))
        out = out.withColumn(f"_unit{k}", F.col(f"_in{k}") * F.col(f"_on{k}"))
        if k + 1 < depth:
            out = out.withColumn(f"_in{k + 1}", F.col(f"_unit{k}") * F.lit(chain.factors[k]) + F.lit(chain.biases[k + 1]))
    error = (F.col(f"_unit{depth - 1}") - F.col("_label")) * F.col(f"_on{depth - 1}")
    out = out.withColumn(f"_error{depth - 1}", error)
    for k in reversed(range(depth - 1)):
        out = out.withColumn(f"_error{k}", F.col(f"_error{k + 1}") * F.lit(chain.factors[k]) * F.col(f"_on{k}"))
    parts = [F.col("_error0") * F.col(c) for c in chain.features]
    parts += [F.col(f"_error{k + 1}") * F.col(f"_unit{k}") for k in range(depth - 1)]
    parts += [F.col(f"_error{k}") for k in range(depth)]
    squared = F.pow(F.col("_told") - F.col("_label"), F.lit(2))
    measured = [F.avg(F.when(F.col("half") == half, squared)) / 2 for half in (TRAIN, TEST)]
    *gradient, train, test = out.agg(*[F.avg(F.when(is_train, p)) for p in parts], *measured).first()
    return [g or 0.0 for g in gradient], {TRAIN: train, TEST: test}


def train_passes(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    half: str = "half",
    start: ReluChain | None = None,
    passes: int = PASSES,
    batches: int = 1,
    rate: float = RATE,
    keep: Sequence[float] | None = None,
) -> tuple[ReluChain, DataFrame]:
    """Fit a chain of relu units on the ``train`` half; the chain, and ``step, half, cost``.

    Each pass visits every batch once, and each batch is one step: the costs of the
    batch's rows in both halves are taken with the weights as they are, then the weights
    move by the batch's gradient, scaled by its running moments. Step 0 is the
    starting point; a last row tells the cost after the last move, on the batch that
    would come next. ``keep`` switches units off at random while training, by shares
    per layer. A half without rows in a batch has no row for the step.
    """
    chain = start or starting_chain(features)
    if keep is not None and len(keep) != len(chain.biases):
        raise ValueError("one kept share per layer")
    rows = deal_batches(df, features, label, key, half, batches)
    first, second = [0.0] * len(chain.numbers), [0.0] * len(chain.numbers)
    history = []
    for step in range(passes * batches + 1):
        batch = rows.where(F.col("_batch") == step % batches)
        gradient, costs = step_sums(batch, chain, step, keep)
        history += [(step, name, cost) for name, cost in costs.items() if cost is not None]
        if step == passes * batches:
            break
        first = [FIRST_DECAY * m + (1 - FIRST_DECAY) * g for m, g in zip(first, gradient)]
        second = [SECOND_DECAY * v + (1 - SECOND_DECAY) * g * g for v, g in zip(second, gradient)]
        pace = rate * math.sqrt(1 - SECOND_DECAY ** (step + 1)) / (1 - FIRST_DECAY ** (step + 1))
        chain = chain.moved([x - pace * m / (math.sqrt(v) + TINY) for x, m, v in zip(chain.numbers, first, second)])
    return chain, df.sparkSession.createDataFrame(history, HISTORY)


def training_history(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], seed: int = 0, fit_on: str = "self", **settings
) -> tuple[ReluChain, DataFrame]:
    """Halve by key, scale each half, and :func:`train_passes`."""
    halves = split_half(df.select(*dict.fromkeys([*key, *features, label])), key, seed)
    return train_passes(scale_by_std(halves, features, fit_on=fit_on), features, label, key, **settings)
