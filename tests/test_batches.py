"""Batch figures and scaling against direct formulas."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from metricweave.operators.batches import batch_metrics, history_range, sample_history
from metricweave.operators.scaling import scale_by_std

numbers = st.floats(-50, 50).map(lambda x: round(x, 2))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=9))
def test_figures_of_one_batch(spark, pairs):
    df = spark.createDataFrame([(0, i, y, t) for i, (y, t) in enumerate(pairs)], "batch int, batch_row int, y double, t double")
    got = batch_metrics(df, "y", "t").first()
    y, t = np.array(pairs).T
    assert got["cost"] == pytest.approx(np.mean((y - t) ** 2) / 2, abs=1e-9)
    # what a column of predictions minus a row of labels evaluates to
    assert got["cost_pairwise"] == pytest.approx(np.sum((y[:, None] - t[None, :]) ** 2) / (2 * len(y)), abs=1e-6)
    assert got["match"] == int(np.argmax(y) == np.argmax(t))


def test_equal_maxima_take_the_first_row(spark):
    df = spark.createDataFrame(
        [(0, 0, 5.0, 1.0), (0, 1, 5.0, 9.0), (1, 0, 5.0, 9.0), (1, 1, 5.0, 9.0)], "batch int, batch_row int, y double, t double")
    assert dict(batch_metrics(df, "y", "t").select("batch", "match").collect()) == {0: 0, 1: 1}


def test_history(spark):
    steps = spark.range(100).withColumnRenamed("id", "batch")
    assert [r[0] for r in sample_history(steps, 25).orderBy("batch").collect()] == [0, 25, 50, 75]
    assert history_range(steps, 20, 90).count() == 70 and history_range(steps, 20).count() == 80


@pytest.fixture(scope="module")
def halves(spark):
    rows = [("train", 1.0, 4.0), ("train", 3.0, 4.0), ("train", 8.0, 4.0), ("test", 2.0, 1.0), ("test", 6.0, None)]
    return spark.createDataFrame(rows, "half string, x double, c double")


def scaled(df, **options):
    out = scale_by_std(df, ["x", "c"], **options)
    return {h: [(r["x"], r["c"]) for r in out.where(F.col("half") == h).orderBy("x").collect()] for h in ("train", "test")}


def test_each_half_by_its_own_deviation(halves):
    got = scaled(halves)
    assert np.allclose([x for x, _ in got["train"]], np.array([1, 3, 8]) / np.std([1, 3, 8]))
    assert np.allclose([x for x, _ in got["test"]], np.array([2, 6]) / np.std([2, 6]))
    # a constant column has no scale
    assert [c for _, c in got["train"]] == [None] * 3 and [c for _, c in got["test"]] == [None, None]


def test_both_halves_by_the_training_deviation(halves):
    got = scaled(halves, fit_on="train")
    assert np.allclose([x for x, _ in got["test"]], np.array([2, 6]) / np.std([1, 3, 8]))


def test_scaling_does_not_shuffle_the_table(halves):
    plan = scale_by_std(halves, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
