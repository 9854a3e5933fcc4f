"""Layered classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from metricweave.operators.sampling import TEST, TRAIN, split_half_by
from metricweave.session import store

# Units of the hidden layers and the number of classes.
HIDDEN = (10, 20, 10)
CLASSES = 3


def as_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric columns, or one array column, as a vector column."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return df.withColumn(name, array_to_vector(F.col(features[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


def fit_layered_classifier(
    vectors: DataFrame,
    width: int,
    label: str = "label",
    hidden: Sequence[int] = HIDDEN,
    classes: int = CLASSES,
    steps: int = 100,
    seed: int = 0,
) -> MultilayerPerceptronClassificationModel:
    """Fit on a ``features`` vector column of ``width`` entries; gradients are summed on executors."""
    trainer = MultilayerPerceptronClassifier(
        layers=[width, *hidden, classes], featuresCol="features", labelCol=label, maxIter=steps, seed=seed
    )
    return trainer.fit(vectors)


def accuracy(predicted: DataFrame, label: str = "label") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(predicted)


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, rows`` for every pair that occurs."""
    pair = [F.col(c).cast("int").alias(n) for c, n in ((label, "label"), (prediction, "prediction"))]
    return predicted.select(*pair).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def beats_largest_class(table: DataFrame) -> bool:
    """Whether a confusion table has more right rows than naming the largest class would have."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0))
    by_class = table.groupBy("label").agg(F.sum("rows").alias("rows"), right.alias("right"))
    row = by_class.agg(F.sum("right").alias("right"), F.max("rows").alias("largest")).first()
    return bool(row["right"] and row["right"] > row["largest"])


def judge_classifier(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    seed: int = 0,
    hidden: Sequence[int] = HIDDEN,
    steps: int = 100,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on one half of every class, judge on the other; the fitted steps and the judged rows.

    A judged row has the key, the label, the features and its ``prediction``;
    :func:`confusion` counts them.
    Classes are the integers from 0 to the largest label. Features are centred and
    scaled by what the fitted half shows; a row with a missing feature or label takes
    no part.
    """
    # written once: the halves are found in several passes
    known = store(df.select(*dict.fromkeys([*key, *features, label])).dropna(subset=[*features, label]), "known")
    halves = store(split_half_by(known, key, seed, label), "halves")
    classes = (halves.agg(F.max(label)).first()[0] or 0) + 1
    trained = halves.where(F.col("half") == TRAIN)
    steps_ = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
            MultilayerPerceptronClassifier(
                layers=[len(features), *hidden, classes], labelCol=label, maxIter=steps, seed=seed
            ),
        ]
    )
    model = steps_.fit(trained)
    judged = model.transform(halves.where(F.col("half") == TEST))
    return model, judged.select(*known.columns, F.col("prediction").cast("int").alias("prediction"))
