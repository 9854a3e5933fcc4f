"""Joins of metric feeds and job history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from metricweave.functions.times import floor_to
from metricweave.operators.projection import fill_missing
from metricweave.session import store

KEY = ("time", "host")


def align_feed(
    df: DataFrame,
    step: int,
    metrics: Mapping[str, str],
    by: Sequence[str] = ("host",),
    time: str = "time",
) -> DataFrame:
    """One sample per grid cell of ``step`` nanoseconds and key.

    Feeds that tick at different rates never meet on equal times. Each metric
    is reduced by the named aggregate (``avg``, ``max``, …); the reduction runs
    on the map side first, and the joins after it meet one row per key.
    """
    return df.groupBy(floor_to(F.col(time), step).alias(time), *by).agg(
        *[F.expr(f"{how}(`{column}`)").alias(column) for column, how in metrics.items()]
    )


def join_metrics(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = KEY,
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join on equal keys: key, left values, right values; repeated keys multiply.

    Spark picks the strategy from measured sizes: no side is broadcast unless
    it is known to be small, and adaptive execution splits skewed partitions.
    Where a plan keeps adaptive splitting from acting (a later step reuses the
    partitioning), ``salts`` splits the hot keys by hand.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if salts is None:
        return left.join(right, list(on), how)
    return _salted(left, right, list(on), how, salts)


def _salted(left: DataFrame, right: DataFrame, on: list[str], how: str, salts: int) -> DataFrame:
    """Spread the left rows of hot keys over ``salts`` partitions.

    A key is hot when it holds more rows than an even share of a shuffle
    partition, so there are fewer hot keys than partitions and their broadcast
    is bounded by that setting. Keys are counted once, into a written table.
    The salt hashes all columns of the row, so it spreads rows wherever they
    lie, also after an earlier join on the same key; the number of the reading
    task is added for rows that are equal. Both are the same when a task runs
    again on the same rows.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = store(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), "keys")
    total = counted.agg(F.sum("_rows")).scalar()
    hot = counted.where(F.col("_rows") > total / partitions).select(*on, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(salts).cast("bigint"))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    copies = F.when(F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("bigint"))).otherwise(F.array(zero))
    repeated = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.drop("_hot").join(repeated, [*on, "_salt"], how).drop("_salt")


def join_jobs(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add the job value of each row's application; rows without a job drop out."""
    return df.join(jobs.select("app_id", "job_value"), "app_id")


def join_optional(left: DataFrame, right: DataFrame, on: Sequence[str] = KEY, fill: int = 0) -> DataFrame:
    """Left join where columns of an absent right row stand in as ``fill``."""
    added = [c for c in right.columns if c not in on]
    return fill_missing(join_metrics(left, right, on, "left"), fill, added)


def union_series(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)
