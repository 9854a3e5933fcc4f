"""Fits and their evaluation against direct solutions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricweave.plans.classifier import accuracy, as_vector, fit_layered_classifier
from metricweave.plans.regression import (
    ClippedLinear,
    evaluate_split,
    fit_relu_regression,
    train_from_csv,
    train_in_batches,
)
from metricweave.sources.csv import write_rows_csv


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-4, 4, (203, 3))
    y = x @ [2.0, -1.0, 0.5] + 1.5 + rng.normal(0, 0.3, 203)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double"), x, y


def test_least_squares(table):
    df, x, y = table
    model = fit_relu_regression(df, ["a", "b", "c"], "y")
    solution, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    assert np.allclose([*model.weights, model.intercept], solution, atol=1e-8)
    got = [r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()]
    assert np.allclose(got, np.maximum(np.c_[x, np.ones(len(x))] @ solution, 0), atol=1e-7)


def test_penalty_on_plain_weights(table):
    df, x, y = table
    model = fit_relu_regression(df, ["a", "b", "c"], "y", l2=0.2)
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = np.linalg.solve(xc.T @ xc / len(x) + 0.2 * np.eye(3), xc.T @ yc / len(x))
    assert np.allclose(model.weights, ridge, atol=1e-6)


def test_upper_bound_and_missing_feature(spark):
    df = spark.createDataFrame([(-3.0,), (1.0,), (9.0,), (None,)], "x double")
    got = df.select(ClippedLinear(("x",), (2.0,), 1.0, upper=10.0).predict()).collect()
    assert [r[0] for r in got] == [0.0, 3.0, 10.0, None]


def test_training_skips_the_closing_batch(table):
    df, x, y = table
    model, costs = train_in_batches(df, ["a", "b", "c"], ["id"], "y")
    got = dict(costs.select("batch", "cost").collect())
    assert sorted(got) == list(range(203 // 5 - 1))
    predicted = np.maximum(x @ np.array(model.weights) + model.intercept, 0)
    assert got[7] == pytest.approx(np.mean((predicted[35:40] - y[35:40]) ** 2) / 2)


def test_training_from_csv(spark, table, tmp_path):
    df, x, y = table
    stored = df.select("id", "a", "b", "c", (F.col("y") * 100).alias("y"))
    write_rows_csv(stored, str(tmp_path / "rows"))
    model, costs = train_from_csv(spark, str(tmp_path / "rows"), ["id", "a", "b", "c", "y"], ["id"], "y")
    label = np.trunc(y * 100)
    design = np.c_[np.arange(203), x, np.ones(203)]
    solution, *_ = np.linalg.lstsq(design, label, rcond=None)
    assert np.allclose([*model.weights, model.intercept], solution, atol=1e-6)
    predicted = np.maximum(design @ solution, 0)
    got = dict(costs.select("batch", "cost").collect())
    assert sorted(got) == list(range(39))
    assert got[3] == pytest.approx(np.mean((predicted[15:20] - label[15:20]) ** 2) / 2)


@pytest.mark.parametrize("fit_on", ["self", "train"])
def test_evaluate_split(table, fit_on):
    df, x, y = table
    got = evaluate_split(df, ["a", "b", "c"], "y", ["id"], seed=4, fit_on=fit_on)
    counts = dict(got.groupBy("half").count().collect())
    # 101 and 102 rows in batches of two, full ones only
    assert counts == {"train": 50, "test": 51}
    mean = got.groupBy("half").agg(F.avg("cost").alias("cost")).collect()
    assert all(0 < r["cost"] < 20 for r in mean)
    assert {r["match"] for r in got.select("match").distinct().collect()} <= {0, 1}


def test_layered_classifier(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0, 0], [6, 6, 0, 0], [0, 0, 6, 6]])
    rows = [(*map(float, rng.normal(centres[i % 3], 0.4)), i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label int")
    vectors = as_vector(df, ["a", "b", "c", "d"])
    model = fit_layered_classifier(vectors, 4, steps=60)
    assert list(model.getLayers()) == [4, 10, 20, 10, 3]
    assert accuracy(model.transform(vectors)) > 0.95
    arrays = df.select(F.array("a", "b", "c", "d").cast("array<float>").alias("v"), "label")
    assert accuracy(model.transform(as_vector(arrays, ["v"]))) > 0.95
