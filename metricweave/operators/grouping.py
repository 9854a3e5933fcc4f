"""Counts, deviations and tag grouping."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Tags that become columns, at most.
MAX_TAGS = 500


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def column_std(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Population standard deviation per column."""
    return df.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def group_series(
    df: DataFrame, patterns: Sequence[str], aggregates: Sequence[Column] | None = None, tags: str | None = None
) -> DataFrame:
    """Group by every column whose *name* matches a pattern; row counts by default.

    ``tags`` names a map column whose matching keys are grouped by as well; a
    row without a key has null there. Keys are looked up first; each becomes a column, so a
    map with more than MAX_TAGS matching keys is refused.
    """
    matches = lambda name: any(re.search(p, name) for p in patterns)
    named = [c for c in df.columns if c != tags and matches(c)]
    if tags is not None:
        every = df.select(F.explode(F.map_keys(tags)).alias("key"))
        wanted = F.lit(False)
        for pattern in patterns:
            wanted = wanted | F.col("key").rlike(pattern)
        found = sorted(k["key"] for k in every.where(wanted).distinct().limit(MAX_TAGS + 1).collect())
        if len(found) > MAX_TAGS:
            raise ValueError(f"more than {MAX_TAGS} tags match {list(patterns)}")
        df = df.withColumns({k: F.col(tags)[k] for k in found})
        named += [k for k in found if k not in named]
    return df.groupBy(*named).agg(*(aggregates or [F.count(F.lit(1)).alias("rows")]))
