"""Training in passes, the fit under the relu and the judged classifier against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricweave.operators.batches import history_range, sample_history
from metricweave.operators.sampling import TEST, TRAIN, split_half_by
from metricweave.plans.classifier import beats_largest_class, confusion, judge_classifier
from metricweave.plans.regression import fit_relu_regression, fit_under_relu
from metricweave.plans.training import ReluChain, _stays_on, deal_batches, starting_chain, train_passes, training_history


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 2, (240, 2))
    y = np.maximum(x @ [1.5, -0.7] + 0.3 + rng.normal(0, 0.1, 240), 0)
    rows = [(i, *map(float, r), float(t), TRAIN if i % 3 else TEST) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, y double, half string")


def plain_passes(parts, chain, passes, rate, masks):
    """The same steps on arrays; ``parts`` holds (x, y, is_train) per batch, ``masks`` units on per step and layer."""
    w, f, b = (np.array(v, float) for v in (chain.weights, chain.factors, chain.biases))
    depth, history = len(b), []
    first = second = np.zeros(len(w) + len(f) + len(b))
    for step in range(passes * len(parts) + 1):
        x, y, train = parts[step % len(parts)]
        told = np.maximum(x @ w + b[0], 0)
        for k in range(1, depth):
            told = np.maximum(told * f[k - 1] + b[k], 0)
        history.append([np.mean((told - y)[part] ** 2) / 2 for part in (train, ~train)])
        units, on = [], []
        into = x @ w + b[0]
        for k in range(depth):
            on.append(np.where(into > 0, masks(step, k), 0.0))
            units.append(into * on[k])
            if k + 1 < depth:
                into = units[k] * f[k] + b[k + 1]
        errors = [None] * depth
        errors[-1] = (units[-1] - y) * on[-1]
        for k in reversed(range(depth - 1)):
            errors[k] = errors[k + 1] * f[k] * on[k]
        mean = lambda v: v[train].mean(axis=0)
        gradient = np.r_[mean(errors[0][:, None] * x), [mean(errors[k + 1] * units[k]) for k in range(depth - 1)], [mean(e) for e in errors]]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        pace = rate * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        moved = np.r_[w, f, b] - pace * first / (np.sqrt(second) + 1e-8)
        w, f, b = moved[: len(w)], moved[len(w) : len(w) + depth - 1], moved[len(w) + depth - 1 :]
    return np.array(history)


@pytest.mark.parametrize("depth, batches, keep", [(1, 1, None), (3, 2, None), (3, 2, (0.8, 0.5, 0.5))])
def test_steps_against_arrays(halves, depth, batches, keep):
    start = ReluChain(("a", "b"), (0.3, 0.2), (1.0, 0.9)[: depth - 1], (0.1, 0.2, 1.0)[:depth])
    _, history = train_passes(halves, ["a", "b"], "y", ["id"], start=start, passes=4, batches=batches, rate=0.05, keep=keep)
    rows = deal_batches(halves, ["a", "b"], "y", ["id"], "half", batches)
    parts, dealt = [], []
    for k in range(batches):
        batch = rows.where(F.col("_batch") == k).orderBy("_drawn")
        got = batch.collect()
        dealt.append(batch)
        parts.append((np.array([[r["a"], r["b"]] for r in got]), np.array([r["_label"] for r in got]), np.array([r["half"] == TRAIN for r in got])))
    assert sum(len(p[1]) for p in parts) == 240 and all(p[2].any() for p in parts)

    def masks(step, layer):
        if keep is None:
            return 1.0
        return np.array([r[0] for r in dealt[step % batches].select(_stays_on(keep[layer], layer, step)).collect()])

    got = {(r["step"], r["half"]): r["cost"] for r in history.collect()}
    wanted = plain_passes(parts, start, 4, 0.05, masks)
    assert len(got) == 2 * (4 * batches + 1)
    for step, (train, test) in enumerate(wanted):
        assert got[step, TRAIN] == pytest.approx(train, rel=1e-9)
        assert got[step, TEST] == pytest.approx(test, rel=1e-9)


def test_cost_falls_and_history_is_cut(halves):
    start = ReluChain(("a", "b"), (0.1, 0.1), (), (0.5,))
    chain, history = train_passes(halves, ["a", "b"], "y", ["id"], start=start, passes=25, rate=0.03)
    train = [r["cost"] for r in history.where(F.col("half") == TRAIN).orderBy("step").collect()]
    assert len(train) == 26 and all(b < a for a, b in zip(train, train[1:]))
    predicted = chain.transform(halves.where(F.col("half") == TRAIN))
    last = predicted.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2))) / 2).first()[0]
    assert last == pytest.approx(train[-1])
    drawn = history_range(sample_history(history, 5, "step"), 10, 25, "step")
    assert sorted({r["step"] for r in drawn.collect()}) == [10, 15, 20]


def test_units_stay_on_by_their_share(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("_drawn"))
    on = rows.select(_stays_on(0.8, 0, 3).alias("on")).where("on > 0")
    assert on.count() / 20_000 == pytest.approx(0.8, abs=0.02) and on.first()[0] == 1.25


def test_missing_values_and_one_empty_half(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 2.0, None), (4, 3.0, 5.0)], "id int, a double, y double")
    _, history = train_passes(df.withColumn("half", F.lit(TRAIN)), ["a"], "y", ["id"], passes=2)
    assert [r["half"] for r in history.collect()] == [TRAIN] * 3
    with pytest.raises(ValueError):
        train_passes(df.withColumn("half", F.lit(TRAIN)), ["a"], "y", ["id"], keep=(0.5, 0.5))


def test_history_from_whole_table(halves):
    _, history = training_history(halves.drop("half"), ["a", "b"], "y", ["id"], 4, passes=3, start=starting_chain(["a", "b"], 3, 7))
    assert history.count() == 8 and history.where("cost IS NULL").isEmpty()


def cost_of(model, df):
    return model.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2))) / 2).first()[0]


def test_relu_fit_finds_the_bent_line(spark):
    x = np.linspace(-3, 3, 301)
    rows = [(float(v), 1000.0 * float(v) ** 2, float(max(2 * v - 1, 0))) for v in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    plain, bent = fit_relu_regression(df, ["a"], "y"), fit_under_relu(df, ["a"], "y")
    assert bent.weights[0] == pytest.approx(2, abs=1e-9) and bent.intercept == pytest.approx(-1, abs=1e-9)
    assert cost_of(bent, df) < 1e-18 < 0.01 < cost_of(plain, df)
    # a second feature of another size carries nothing
    both = fit_under_relu(df, ["a", "b"], "y")
    assert both.weights == pytest.approx([2, 0], abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_relu_fit_never_costs_more(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [1, 50, 0.01], (300, 3))
    y = np.maximum(x @ [1.0, 0.02, -60.0] + rng.normal(0, 0.5, 300) - 0.2, 0)
    assert 0.4 < (y == 0).mean() < 0.7
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    names = ["a", "b", "c"]
    bent = fit_under_relu(df, names, "y")
    best = cost_of(bent, df)
    assert best < cost_of(fit_relu_regression(df, names, "y"), df)
    weights, scale = np.array([*bent.weights, bent.intercept]), np.array([1, 0.02, 100, 1])
    # no line close by costs less; the cost has several valleys, so this says nothing of lines further off
    for _ in range(200):
        w = weights + rng.normal(0, 1e-6, 4) * scale
        assert np.mean((np.maximum(x @ w[:3] + w[3], 0) - y) ** 2) / 2 >= best * (1 - 1e-9)


def test_relu_fit_between_two_bounds(spark):
    x = np.linspace(-3, 3, 301)
    df = spark.createDataFrame([(float(v), float(np.clip(2 * v - 1, 0, 3))) for v in x], "a double, y double")
    model = fit_under_relu(df, ["a"], "y", upper=3.0)
    assert model.weights[0] == pytest.approx(2, abs=1e-6) and model.intercept == pytest.approx(-1, abs=1e-6)


def test_relu_fit_odd_tables(spark):
    same = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (None, 3.0), (2.0, None)], "a double, y double")
    assert fit_under_relu(same, ["a"], "y").transform(same.limit(1)).first()["prediction"] == pytest.approx(5)
    below = spark.createDataFrame([(float(v), -4.0) for v in range(5)], "a double, y double")
    assert [r["prediction"] for r in fit_under_relu(below, ["a"], "y").transform(below).collect()] == [0.0] * 5
    filled = fit_under_relu(same, ["a"], "y", missing=-1.0)
    assert filled.transform(same).where("prediction IS NULL").isEmpty()


@pytest.mark.parametrize("bucket", [2, 250_000])
def test_halves_of_every_class(spark, bucket, monkeypatch):
    from metricweave.operators import sampling

    kinds = [None, 0, 1, 1, 1, 1, 1, 7]
    rows = [(i, kinds[i % len(kinds)]) for i in range(900)] + [(9_000, 4)]
    df = spark.createDataFrame(rows, "id int, kind int")
    cuts = lambda *a: sampling_cuts(*a, bucket)
    sampling_cuts = sampling.class_cuts
    monkeypatch.setattr(sampling, "class_cuts", cuts)
    got = {r["id"]: r["half"] for r in split_half_by(df, ["id"], 5, "kind").collect()}
    wanted = {}
    for kind in {k for _, k in rows}:
        own = sorted((hashlib.md5(f"{i}:5".encode()).hexdigest(), i) for i, k in rows if k == kind)
        wanted |= {i: TRAIN if n < len(own) // 2 else TEST for n, (_, i) in enumerate(own)}
    assert got == wanted
    assert split_half_by(df.limit(0), ["id"], 5, "kind").count() == 0


def test_judged_classifier(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        kind = 0 if i % 4 else 1 + i // 4 % 2
        rows.append((i, *map(float, rng.normal([0, 5, 0][kind], 0.4, 1)), *map(float, rng.normal([0, 0, 900][kind], 40, 1)), kind))
    df = spark.createDataFrame([*rows, (900, None, 1.0, 0), (901, 1.0, 1.0, None)], "id int, a double, b double, kind int")
    _, unseen = judge_classifier(df, ["a", "b"], "kind", ["id"], steps=60)
    table = confusion(unseen, "kind")
    assert beats_largest_class(table) and unseen.columns == ["id", "a", "b", "kind", "prediction"]
    assert {tuple(r) for r in table.collect()} == {(0, 0, 90), (1, 1, 15), (2, 2, 15)}
    # noise for features gives another table
    noisy = df.withColumn("a", F.xxhash64("id") / 1e18).withColumn("b", F.xxhash64("id", "id") / 1e18)
    noise = confusion(judge_classifier(noisy, ["a", "b"], "kind", ["id"], steps=30)[1], "kind")
    assert {tuple(r) for r in noise.collect()} != {tuple(r) for r in table.collect()}
    assert noise.agg(F.sum("rows")).first()[0] >= 120
    constant = spark.createDataFrame([(0, 0, 90), (1, 0, 30)], "label int, prediction int, rows bigint")
    assert not beats_largest_class(constant) and not beats_largest_class(constant.limit(0))
