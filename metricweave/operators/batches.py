"""Consecutive batches and the figures taken per batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.operators.numbering import number_rows


def assign_batches(
    df: DataFrame,
    order: Sequence[str],
    size: int,
    tail: str = "keep",
    unique: bool = True,
) -> DataFrame:
    """Add ``batch`` (from 0) and ``batch_row`` (from 0 inside a batch), in ``order``.

    ``tail`` says what becomes of the end of the table: ``keep`` everything,
    only ``full`` batches, or ``skip_last`` to leave out the last full batch too.
    """
    numbered = number_rows(df, order, "_position", unique)
    at = F.col("_position") - 1
    row = F.pmod(at, F.lit(size).cast("bigint"))
    out = numbered.select(
        *df.columns,
        F.call_function("div", at, F.lit(size).cast("bigint")).alias("batch"),
        row.cast("int").alias("batch_row"),
    )
    if tail == "keep":
        return out
    if tail not in ("full", "skip_last"):
        raise ValueError(f"unknown tail handling: {tail}")
    # counted on the written table, not on its source
    rows = numbered.agg(F.count(F.lit(1))).scalar()
    batches = F.call_function("div", rows, F.lit(size).cast("bigint"))
    return out.where(F.col("batch") < (batches if tail == "full" else batches - 1))


def cost(predicted: Column, label: Column) -> Column:
    """Half the mean squared error of a group."""
    return F.sum(F.pow(predicted - label, F.lit(2))) / (2 * F.count(F.lit(1)))


def pairwise_cost(predicted: Column, label: Column) -> Column:
    """Half the mean over i of Σⱼ(yᵢ − tⱼ)², every prediction against every label.

    Expanding the square leaves sums over single rows, so no pair is formed.
    """
    rows = F.count(F.lit(1))
    squares = F.sum(predicted * predicted) + F.sum(label * label)
    return squares / 2 - F.sum(predicted) * F.sum(label) / rows


def argmax_match(predicted: Column, label: Column, row: Column) -> Column:
    """1 when the largest prediction and the largest label sit on the same row.

    Among equal maxima the first row counts.
    """
    def first_largest(value: Column) -> Column:
        return F.max(F.struct(value.alias("value"), (-row).alias("back")))["back"]

    return (first_largest(predicted) == first_largest(label)).cast("int")


def batch_metrics(
    df: DataFrame, predicted: str, label: str, by: Sequence[str] = ("batch",), row: str = "batch_row"
) -> DataFrame:
    """All three figures per batch in one aggregation."""
    y, t = F.col(predicted), F.col(label)
    return df.groupBy(*by).agg(
        cost(y, t).alias("cost"),
        pairwise_cost(y, t).alias("cost_pairwise"),
        argmax_match(y, t, F.col(row)).alias("match"),
    )


def sample_history(df: DataFrame, every: int, step: str = "batch") -> DataFrame:
    """Keep the steps that are multiples of ``every``."""
    return df.where(F.col(step) % every == 0)


def history_range(df: DataFrame, start: int, stop: int | None = None, step: str = "batch") -> DataFrame:
    """Steps from ``start`` up to, but not including, ``stop``."""
    keep = F.col(step) >= start
    return df.where(keep if stop is None else keep & (F.col(step) < stop))
