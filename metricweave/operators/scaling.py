"""Division by the standard deviation, without centring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.operators.sampling import TEST, TRAIN


def part_deviations(
    df: DataFrame, columns: Sequence[str], part: str = "half", parts: Sequence[str] = (TRAIN, TEST)
) -> dict[tuple[str, str], float | None]:
    """Population deviation of every column in every part, from one aggregation."""
    wanted = [(p, c) for p in parts for c in columns]
    found = df.agg(*[F.stddev_pop(F.when(F.col(part) == p, F.col(c))).alias(f"_{i}") for i, (p, c) in enumerate(wanted)])
    return dict(zip(wanted, found.first()))


def scale_by_std(
    df: DataFrame,
    columns: Sequence[str],
    part: str = "half",
    parts: Sequence[str] = (TRAIN, TEST),
    fit_on: str = "self",
) -> DataFrame:
    """Each column over the population deviation of its part.

    ``fit_on='self'`` scales a part by its own deviation, any other value names
    the part whose deviation scales all of them. A deviation of zero gives
    null. The deviations are looked up beforehand and enter as constants, so
    the table is not shuffled.
    """
    if fit_on != "self" and fit_on not in parts:
        raise ValueError(f"no such part: {fit_on}")
    deviations = part_deviations(df, columns, part, parts if fit_on == "self" else [fit_on])

    def divisor(column: str) -> Column:
        chosen = F.lit(None).cast("double")
        for p in parts:
            deviation = deviations[p if fit_on == "self" else fit_on, column]
            chosen = F.when(F.col(part) == p, F.lit(deviation or None).cast("double")).otherwise(chosen)
        return chosen

    return df.withColumns({c: F.col(c) / divisor(c) for c in columns})
