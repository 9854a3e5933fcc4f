"""Fits and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.catalog.batches import PLACED, SEED
from metricweave.catalog.joins import UNIFY_SQL, unified
from metricweave.catalog.registry import Tables, query, with_points
from metricweave.operators.projection import split_label
from metricweave.operators.batches import history_range, sample_history
from metricweave.plans.classifier import beats_largest_class, confusion, judge_classifier
from metricweave.plans.regression import evaluate_split, fit_relu_regression, fit_under_relu, train_from_csv
from metricweave.plans.training import ReluChain, training_history
from metricweave.plans.unify import FEATURES
from metricweave.session import scratch_path, store
from metricweave.sources.csv import read_rows_csv, write_rows_csv


@query(
    "relu_regression",
    with_points(
        """SELECT event_id, round(greatest(0, k * f.slope + f.intercept), 6) AS prediction
        FROM points, (SELECT regr_slope(value, k) AS slope, regr_intercept(value, k) AS intercept FROM points) f"""
    ),
)
def _relu(t: Tables):
    points = t.points.select("event_id", "k", "value")
    model = fit_relu_regression(points, ["k"], "value")
    return model.transform(points).select("event_id", F.round("prediction", 6).alias("prediction"))


EVALUATED = """
scaled AS (SELECT *, k / stddev_pop(k) OVER (PARTITION BY half) AS x FROM halves),
fit AS (SELECT regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM scaled WHERE half = 'train'),
sizes AS (SELECT count(*) AS n, count(*) // 2 AS h FROM points),
predicted AS (
    SELECT half, value, greatest(0, x * slope + intercept) AS y,
        position - 1 - CASE WHEN half = 'test' THEN h ELSE 0 END AS idx, CASE WHEN half = 'test' THEN n - h ELSE h END AS rows
    FROM scaled, fit, sizes),
ranked AS (
    SELECT half, idx // 2 AS batch, value, y, rows,
        first_value(idx) OVER (PARTITION BY half, idx // 2 ORDER BY y DESC, idx) AS best_y,
        first_value(idx) OVER (PARTITION BY half, idx // 2 ORDER BY value DESC, idx) AS best_value
    FROM predicted)
SELECT half, batch, round(sum((y - value) ** 2) / (2 * count(*)), 3) AS cost,
    CAST(max(best_y = best_value) AS INTEGER) AS match
FROM ranked WHERE batch < rows // 2 GROUP BY half, batch"""


@query("evaluate_split", with_points(PLACED + "," + EVALUATED))
def _evaluate(t: Tables):
    points = t.points.select("event_id", "k", "value")
    result = evaluate_split(points, ["k"], "value", ["event_id"], SEED)
    return result.select("half", "batch", F.round("cost", 3).alias("cost"), "match")


# The label is a container's figure; these come from the host's other feeds.
HOST_FEATURES = ["cpu_8", "mem_2"]


UNIFIED_FIT = f"""WITH unified AS ({UNIFY_SQL}),
    moments AS (
        SELECT var_pop(cpu_8) AS aa, var_pop(mem_2) AS bb, covar_pop(cpu_8, mem_2) AS ab, covar_pop(cpu_8, label) AS cov_a,
            covar_pop(mem_2, label) AS cov_b, avg(cpu_8) AS a, avg(mem_2) AS b, avg(label) AS y
        FROM unified),
    fit AS (
        SELECT (cov_a * bb - cov_b * ab) / (aa * bb - ab * ab) AS u, (cov_b * aa - cov_a * ab) / (aa * bb - ab * ab) AS v, a, b, y
        FROM moments),
    predicted AS (SELECT *, greatest(0, y + u * (cpu_8 - a) + v * (mem_2 - b)) AS prediction FROM unified, fit)"""
# The order of the batches; no two unified rows agree in all of it.
BATCH_ORDER = ["time", "container_number", "app_number"]


@query(
    "unified_regression",
    UNIFIED_FIT
    + """,
    numbered AS (
        SELECT *, (row_number() OVER (ORDER BY time, container_number, app_number) - 1) // 5 AS batch, count(*) OVER () AS n
        FROM predicted)
    SELECT batch, round(sum((prediction - label) ** 2) / (2 * count(*)), 4) AS cost
    FROM numbered WHERE batch < n // 5 - 1 GROUP BY batch""",
)
def _unified(t: Tables):
    """Unified rows to CSV and back, a fit on the host's features, and the cost of each batch of five."""
    path = scratch_path(t.spark, "unified")
    columns = ["time", *FEATURES, "label"]
    rounded = {c: F.round(c, 6) for c in ("cpu_8", "mem_2", "nm_39")}
    exact = {c: F.col(c).cast("decimal(38,0)") for c in BATCH_ORDER[1:]}
    write_rows_csv(unified(t).withColumns(rounded | exact).select(*columns), path)
    _, costs = train_from_csv(t.spark, path, columns, BATCH_ORDER, features=HOST_FEATURES)
    return costs.select("batch", F.round("cost", 4).alias("cost"))


@query(
    "unified_fit",
    UNIFIED_FIT + " SELECT time, label, round(prediction, 4) AS prediction FROM predicted",
)
def _unified_fit(t: Tables):
    """Unified rows to CSV and back, then a fit on features that do not hold the label."""
    path = scratch_path(t.spark, "unified")
    columns = ["time", *FEATURES, "label"]
    rounded = {c: F.round(c, 6) for c in ("cpu_8", "mem_2", "nm_39")}
    write_rows_csv(unified(t).withColumns(rounded).select(*columns), path)
    text = read_rows_csv(t.spark, path, len(columns)).toDF(*columns)
    typed = text.withColumns({"time": F.col("time").cast("bigint")} | {c: F.col(c).cast("double") for c in HOST_FEATURES})
    rows = store(split_label(typed, "label", ["time", *HOST_FEATURES]), "typed")
    model = fit_relu_regression(rows, HOST_FEATURES)
    return model.transform(rows).select("time", "label", F.round("prediction", 4).alias("prediction"))


def measured_documents(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """Figures of each document's text, and the other columns of ``documents``."""
    documents = t.documents.select("doc_id", "text") if documents is None else documents
    text = F.col("text")
    chars, words = F.length(text).cast("double"), F.size(F.split(text, "[ \\n]"))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / F.greatest(chars, F.lit(1.0))
    figures = {
        "words": words,
        "chars": chars,
        "lines": F.size(F.split(text, "\n")),
        "symbols": share(r"[^#*$%&|<>]"),
        "exclaims": share("[^!]"),
        "digits": share("[^0-9]"),
        "capitals": share(r"[^\p{Lu}]"),
        "fresh": F.size(F.array_distinct(F.split(text, "[ \\n]"))) / words,
        "fresh_lines": F.size(F.array_distinct(F.split(text, "\n"))) / F.size(F.split(text, "\n")),
    }
    kept = [c for c in documents.columns if c != "text"]
    return documents.where(text.isNotNull()).select(*kept, *[v.cast("double").alias(c) for c, v in figures.items()])


WORDS_SQL = """
measured AS (SELECT doc_id, len(regexp_split_to_array(text, '[ \n]'))::DOUBLE AS words, length(text)::DOUBLE AS chars FROM documents WHERE text IS NOT NULL)"""

# Characters beyond these are the label of the fit under the relu; most documents have none.
FREE_CHARS = 1000


@query(
    "relu_fit",
    f"""WITH RECURSIVE {WORDS_SQL},
    rows_ AS (SELECT doc_id, words AS x, greatest(chars - {FREE_CHARS}, 0) AS y FROM measured),
    fits(i, w, b, best, settled) AS (
        SELECT 0, w, b, avg((greatest(0, w * x + b) - y) ** 2) / 2, false
        FROM rows_, (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM rows_) GROUP BY w, b
        UNION ALL
        SELECT i + 1, CASE WHEN lower_ THEN nw ELSE w END, CASE WHEN lower_ THEN nb ELSE b END,
            CASE WHEN lower_ THEN cost ELSE best END, NOT lower_
        FROM (
            SELECT i, w, b, best, arg_min(nw, cost) AS nw, arg_min(nb, cost) AS nb, min(cost) AS cost,
                min(cost) < best * (1 - 1e-12) AS lower_
            FROM (
                SELECT i, w, b, best, k, nw, nb, avg((greatest(0, nw * x + nb) - y) ** 2) / 2 AS cost
                FROM (
                    SELECT i, w, b, best, k, w + (u - w) / pow(2, k) AS nw, b + (v - b) / pow(2, k) AS nb
                    FROM (
                        SELECT i, w, b, best, regr_slope(y, x) FILTER (w * x + b > 0) AS u,
                            regr_intercept(y, x) FILTER (w * x + b > 0) AS v
                        FROM fits, rows_ WHERE NOT settled GROUP BY i, w, b, best),
                    range(0, 11) AS halved(k)),
                rows_ GROUP BY ALL)
            GROUP BY i, w, b, best))
    SELECT doc_id, round(greatest(0, w * x + b), 4) AS prediction
    FROM rows_, (SELECT w, b FROM fits ORDER BY i DESC LIMIT 1)""",
)
def _relu_fit(t: Tables):
    """A clipped line fitted under the clipping, where most labels sit on the bound."""
    label = F.greatest(F.col("chars") - FREE_CHARS, F.lit(0.0))
    rows = store(measured_documents(t).select("doc_id", "words", label.alias("label")), "words")
    model = fit_under_relu(rows, ["words"])
    return model.transform(rows).select("doc_id", F.round("prediction", 4).alias("prediction"))


# Weights the training starts from, its rate and passes.
BEGIN, PACE, ROUNDS = (0.1, 0.0), 0.05, 50
HISTORY_SQL = f"""WITH RECURSIVE {WORDS_SQL},
placed AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':{SEED}')) AS position FROM measured),
halves AS (SELECT *, CASE WHEN position <= (SELECT count(*) FROM measured) // 2 THEN 'train' ELSE 'test' END AS half FROM placed),
rows_ AS (SELECT half, words / stddev_pop(words) OVER (PARTITION BY half) AS x, chars / 1000 AS y FROM halves),
steps(step, w, b, mw, vw, mb, vb, train, test, following) AS (
    SELECT -1::BIGINT, {BEGIN[0]}::DOUBLE, {BEGIN[1]}::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE,
        {{'w': {BEGIN[0]}::DOUBLE, 'b': {BEGIN[1]}::DOUBLE}}
    UNION ALL
    SELECT step, w, b, mw, vw, mb, vb, train, test,
        {{'w': w - pace * mw / (sqrt(vw) + 1e-8), 'b': b - pace * mb / (sqrt(vb) + 1e-8)}}
    FROM (
        SELECT step, w, b, train, test, 0.9 * mw + 0.1 * gw AS mw, 0.999 * vw + 0.001 * gw * gw AS vw,
            0.9 * mb + 0.1 * gb AS mb, 0.999 * vb + 0.001 * gb * gb AS vb,
            {PACE} * sqrt(1 - pow(0.999, step + 1)) / (1 - pow(0.9, step + 1)) AS pace
        FROM (
            SELECT s.step + 1 AS step, following.w AS w, following.b AS b, mw, vw, mb, vb,
                avg(CASE WHEN following.w * x + following.b > 0 THEN (following.w * x + following.b - y) * x ELSE 0 END)
                    FILTER (half = 'train') AS gw,
                avg(CASE WHEN following.w * x + following.b > 0 THEN following.w * x + following.b - y ELSE 0 END)
                    FILTER (half = 'train') AS gb,
                avg((greatest(0, following.w * x + following.b) - y) ** 2) FILTER (half = 'train') / 2 AS train,
                avg((greatest(0, following.w * x + following.b) - y) ** 2) FILTER (half = 'test') / 2 AS test
            FROM steps s, rows_ WHERE s.step < {ROUNDS} GROUP BY ALL))),
history AS (
    SELECT step, 'train' AS half, round(train, 6) AS cost FROM steps WHERE step >= 0
    UNION ALL SELECT step, 'test', round(test, 6) FROM steps WHERE step >= 0)"""


def trained(t: Tables):
    """Fifty passes over the documents: their length in thousands of characters by their words."""
    docs = measured_documents(t).select("doc_id", "words", (F.col("chars") / 1000).alias("label"))
    start = ReluChain(("words",), BEGIN[:1], (), BEGIN[1:])
    _, history = training_history(
        store(docs, "measured"), ["words"], "label", ["doc_id"], SEED, start=start, passes=ROUNDS, rate=PACE
    )
    return history.withColumn("cost", F.round("cost", 6))


@query("training_history", HISTORY_SQL + " SELECT step, half, cost FROM history")
def _training(t: Tables):
    """Cost of both halves after every step."""
    return trained(t)


@query("training_curve", HISTORY_SQL + " SELECT step, half, cost FROM history WHERE step % 5 = 0 AND step >= 20 AND step < 50")
def _curve(t: Tables):
    """The part of the history that is drawn: every fifth step, from 20 up to 50."""
    return history_range(sample_history(trained(t), 5, "step"), 20, 50, "step")


QUALITY_FEATURES = ["words", "lines", "symbols", "exclaims", "digits", "capitals", "fresh", "fresh_lines"]


HALVED = f"""WITH placed AS (
        SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':{SEED}')) AS position,
            count(*) OVER (PARTITION BY quality) AS n
        FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL)"""


def judged(t: Tables) -> DataFrame:
    """Documents of the half that the classifier of their quality was not fitted on, with its prediction."""
    labelled = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    known = measured_documents(t, labelled)
    return judge_classifier(known, QUALITY_FEATURES, "quality", ["doc_id"], SEED, steps=50)[1]


@query("layered_classifier", HALVED + " SELECT doc_id, quality AS label, quality AS prediction FROM placed WHERE position > n // 2")
def _classifier(t: Tables):
    """Every unseen document of the small table is told right; the SQL knows its label only."""
    return judged(t).select("doc_id", F.col("quality").alias("label"), "prediction")


@query(
    "classifier_confusion",
    HALVED + " SELECT quality AS label, quality AS prediction, count(*) AS rows FROM placed WHERE position > n // 2 GROUP BY quality",
)
def _confusion(t: Tables):
    return confusion(judged(t), "quality")


@query(
    "classifier_halves",
    HALVED
    + """ SELECT quality AS label, count(*) FILTER (position <= n // 2) AS train_rows,
        count(*) FILTER (position > n // 2) AS judged_rows, true AS beats_largest_class FROM placed GROUP BY quality""",
)
def _classifier_halves(t: Tables):
    """Rows of every class that were fitted and judged, and whether the classifier is worth more than its largest class."""
    table = store(confusion(judged(t), "quality"), "confusion")
    all_rows = t.documents.where("text IS NOT NULL").join(t.labels.where("quality IS NOT NULL"), "doc_id").groupBy(F.col("quality").alias("label"))
    unseen = table.groupBy("label").agg(F.sum("rows").alias("judged_rows"))
    counted = all_rows.agg(F.count(F.lit(1)).alias("rows")).join(unseen, "label")
    return counted.select(
        "label", (F.col("rows") - F.col("judged_rows")).alias("train_rows"), "judged_rows",
        F.lit(beats_largest_class(table)).alias("beats_largest_class"),
    )
