"""Permutation, halves, scaling, batches and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.operators.batches import (
    assign_batches,
    batch_metrics,
    history_range,
    sample_history,
)
from metricweave.operators.sampling import shuffle_rows, split_half
from metricweave.operators.scaling import scale_by_std

SEED = 7
PLACED = """placed AS (
    SELECT *, row_number() OVER (ORDER BY md5(event_id || ':7')) AS position FROM points),
halves AS (
    SELECT *, CASE WHEN position <= (SELECT count(*) FROM points) // 2 THEN 'train' ELSE 'test' END AS half FROM placed)"""


@query("shuffle_rows", with_points(PLACED + " SELECT event_id, position FROM placed"))
def _shuffle(t: Tables):
    return shuffle_rows(t.points.select("event_id"), ["event_id"], SEED)


@query("shuffle_split", with_points(PLACED + " SELECT event_id, half FROM halves"))
def _split(t: Tables):
    return split_half(t.points.select("event_id"), ["event_id"], SEED)


@query(
    "scale_std",
    with_points(
        PLACED
        + """ SELECT event_id, half, round(value / stddev_pop(value) OVER (PARTITION BY half), 6) AS value,
            round(k / stddev_pop(k) OVER (PARTITION BY half), 6) AS k FROM halves"""
    ),
)
def _scale(t: Tables):
    return _scaled(t, "self")


@query(
    "scale_std_train",
    with_points(
        PLACED
        + """ SELECT event_id, half, round(value / s.value_std, 6) AS value, round(k / s.k_std, 6) AS k
        FROM halves, (SELECT stddev_pop(value) AS value_std, stddev_pop(k) AS k_std FROM halves WHERE half = 'train') s"""
    ),
)
def _scale_train(t: Tables):
    return _scaled(t, "train")


def _scaled(t: Tables, fit_on: str) -> DataFrame:
    halves = split_half(t.points.select("event_id", "value", "k"), ["event_id"], SEED)
    scaled = scale_by_std(halves, ["value", "k"], fit_on=fit_on)
    return scaled.select("event_id", "half", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


def in_batches(t: Tables, size: int = 5, tail: str = "keep") -> DataFrame:
    """Consecutive points; ``k`` plays the prediction and ``value`` the label."""
    return assign_batches(t.points.select("event_id", "k", "value"), ["event_id"], size, tail)


BATCHES = """numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM points),
batches AS (
    SELECT event_id, k, value, idx // 5 AS batch, CAST(idx % 5 AS INTEGER) AS batch_row,
        first_value(idx % 5) OVER (PARTITION BY idx // 5 ORDER BY k DESC, idx) AS best_k,
        first_value(idx % 5) OVER (PARTITION BY idx // 5 ORDER BY value DESC, idx) AS best_value
    FROM numbered),
figures AS (
    SELECT batch, round(sum((k - value) ** 2) / (2 * count(*)), 6) AS cost,
        round((sum(k * k) + sum(value * value)) / 2 - sum(k) * sum(value) / count(*), 6) AS cost_pairwise,
        CAST(max(best_k = best_value) AS INTEGER) AS match
    FROM batches GROUP BY batch)"""


@query("assign_batches", with_points(BATCHES + " SELECT event_id, batch, batch_row FROM batches"))
def _batches(t: Tables):
    return in_batches(t).select("event_id", "batch", "batch_row")


@query(
    "assign_batches_skip_last",
    with_points(
        BATCHES
        + """ SELECT event_id, batch, batch_row FROM batches
        WHERE batch < (SELECT count(*) FROM points) // 5 - 1"""
    ),
)
def _skip_last(t: Tables):
    return in_batches(t, tail="skip_last").select("event_id", "batch", "batch_row")


@query(
    "assign_batches_full",
    with_points(
        """numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM points)
        SELECT event_id, idx // 7 AS batch, CAST(idx % 7 AS INTEGER) AS batch_row FROM numbered
        WHERE idx // 7 < (SELECT count(*) FROM points) // 7"""
    ),
)
def _full(t: Tables):
    return in_batches(t, 7, "full").select("event_id", "batch", "batch_row")


def figures(t: Tables) -> DataFrame:
    measured = batch_metrics(in_batches(t), "k", "value")
    return measured.withColumns({c: F.round(c, 6) for c in ("cost", "cost_pairwise")})


@query("batch_cost", with_points(BATCHES + " SELECT batch, cost FROM figures"))
def _cost(t: Tables):
    return figures(t).select("batch", "cost")


@query("batch_cost_pairwise", with_points(BATCHES + " SELECT batch, cost_pairwise FROM figures"))
def _pairwise(t: Tables):
    return figures(t).select("batch", "cost_pairwise")


@query("batch_match", with_points(BATCHES + " SELECT batch, match FROM figures"))
def _match(t: Tables):
    return figures(t).select("batch", "match")


@query(
    "history",
    with_points(
        BATCHES
        + """ SELECT batch // 5 AS step, cost, match FROM figures
        WHERE batch % 5 = 0 AND batch // 5 >= 20 AND batch // 5 < 90"""
    ),
)
def _history(t: Tables):
    """Every fifth batch is recorded; recorded steps 20 up to 90 are kept."""
    recorded = sample_history(figures(t), 5).select(F.expr("batch div 5").alias("step"), "cost", "match")
    return history_range(recorded, 20, 90, "step")


@query(
    "history_tail",
    with_points(BATCHES + " SELECT batch, cost, cost_pairwise, match FROM figures WHERE batch >= 20"),
)
def _tail(t: Tables):
    return history_range(figures(t), 20)


LINE_ORDER = ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_orderkey", "l_linenumber"]


@query(
    "batch_cost_copies",
    f"""SELECT batch, round(sum((l_quantity - l_linenumber) ** 2) / (2 * count(*)), 6) AS cost
    FROM (SELECT *, (row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1) // 5 AS batch FROM lineitem)
    GROUP BY batch""",
)
def _copies(t: Tables):
    """Batches of a table whose order key repeats: equal rows are folded, counted and numbered."""
    lines = t.lineitem.select(*LINE_ORDER)
    batches = assign_batches(lines, LINE_ORDER, 5, unique=False)
    measured = batch_metrics(batches, "l_quantity", "l_linenumber")
    return measured.select("batch", F.round("cost", 6).alias("cost"))
