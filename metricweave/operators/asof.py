"""Feeds that tick apart: each row meets the other feed's last row up to its own time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from metricweave.operators.numbering import PLACE_BITS
from metricweave.session import store


def join_latest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("host",),
    time: str = "time",
    tolerance: int | None = None,
    how: str = "left",
    right_time: str | None = None,
) -> DataFrame:
    """Every left row with the values of the latest right row of its key at or before its time.

    A right row older than ``tolerance``, in units of ``time``, counts as absent.
    Without a right row the values are null, or with ``how="inner"`` the left row is
    left out. Of right rows of one key and time the largest, column by column in their
    order, is taken. Null keys and times meet nothing; left rows that are equal stay
    apart. ``right_time`` names a column for the time of the right row.

    Both feeds are put into one table, range-partitioned by key and time and written
    once. A value is carried forward inside each partition, and one row per key and
    partition carries the last value of the partitions before into it; so nothing is
    compared by range, and a key with most of the rows lies in as many partitions as
    it needs.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    by = list(by)
    added = [c for c in right.columns if c not in by and c != time]
    values = F.struct(F.col(time).alias("_time"), *[F.col(c).alias(c) for c in added])
    known = right.dropna(subset=[*by, time]).select(
        *by, F.col(time).alias("_at"), F.lit(0).alias("_side"), values.alias("_right"), F.lit(None).cast(left.schema).alias("_left"),
        F.lit(0).cast("bigint").alias("_spread"),
    )
    asked = left.select(
        *by, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_right"].dataType).alias("_right"),
        F.struct(*left.columns).alias("_left"), F.xxhash64(*left.columns).alias("_spread"),
    )
    order = [*by, "_at", "_side", "_right", "_spread"]
    both = known.unionByName(asked)
    placed = store(
        both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "latest"
    ).withColumn("_piece", F.shiftright("_place", PLACE_BITS))

    # one row per key and partition: the last right row there, then the last one before each
    closing = placed.groupBy(*by, "_piece").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_place"))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    opening = closing.select(*by, "_piece", F.last("_last", ignorenulls=True).over(earlier).alias("_right")).where("_right IS NOT NULL")
    pieces = placed.unionByName(opening.withColumn("_place", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    along = Window.partitionBy(*by, "_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = pieces.withColumn("_found", F.last("_right", ignorenulls=True).over(along)).where("_left IS NOT NULL")
    found = F.col("_found")
    if tolerance is not None:
        found = F.when(F.col("_found._time") >= F.col("_at") - F.lit(tolerance), found)
    met = carried.withColumn("_found", found)
    if how == "inner":
        met = met.where("_found IS NOT NULL")
    times = [] if right_time is None else [F.col("_found._time").alias(right_time)]
    return met.select("_left.*", *[F.col("_found")[c].alias(c) for c in added], *times)
