"""Measurements as stored tables: partitioned for scans by name and day, or bucketed for joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricweave.functions.predicates import tag_matches, time_between
from metricweave.functions.times import DAY_NS, floor_to
from metricweave.operators.joins import KEY
from metricweave.sources.series import first_n_per_series

ROWS, NAMES = "rows", "names"
DAY = "day"


def day_of(time: Column) -> Column:
    """Days since the epoch of a time in nanoseconds."""
    return F.call_function("div", floor_to(time, DAY_NS), F.lit(DAY_NS).cast("bigint")).cast("int")


def write_measurements(points: DataFrame, path: str, measurement: str = "measurement", time: str = "time") -> None:
    """Points in one folder per measurement and day, and a small table of the measurements' names.

    Rebalancing lets adaptive execution give a large measurement and day several tasks
    and put small ones together, so files are neither tiny nor written by one task.
    """
    rows = points.withColumn(DAY, day_of(F.col(time))).hint("rebalance", measurement, DAY)
    rows.write.partitionBy(measurement, DAY).parquet(f"{path}/{ROWS}")
    spark = points.sparkSession
    names = spark.read.schema(rows.schema).parquet(f"{path}/{ROWS}").select(F.col(measurement)).distinct()
    names.coalesce(1).write.parquet(f"{path}/{NAMES}")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{ROWS}")


def scan_stored(
    spark: SparkSession,
    path: str,
    patterns: Sequence[str] = (),
    exact: Sequence[str] = (),
    after: int | None = None,
    before: int | None = None,
    per_series_limit: int | None = None,
    measurement: str = "measurement",
    time: str = "time",
    order: Sequence[str] = ("time",),
) -> DataFrame:
    """Measurements named exactly or by pattern, in an open time range, from the stored layout.

    Patterns are matched against the table of names; what they choose prunes the
    folders of the rows when the query runs. The time range prunes days beforehand.
    Exact names alone are a plain filter on the folders.
    """
    rows = read_measurements(spark, path).where(time_between(F.col(time), after, before))
    if after is not None:
        rows = rows.where(F.col(DAY) >= day_of(F.lit(after)))
    if before is not None:
        rows = rows.where(F.col(DAY) <= day_of(F.lit(before)))
    named = F.col(measurement).isin(*exact) if exact else F.lit(False)
    if patterns:
        for pattern in patterns:
            named = named | tag_matches(F.col(measurement), pattern)
        chosen = spark.read.parquet(f"{path}/{NAMES}").where(named)
        rows = rows.join(chosen, measurement, "left_semi")
    else:
        rows = rows.where(named)
    rows = rows.drop(DAY)
    return rows if per_series_limit is None else first_n_per_series(rows, per_series_limit, [measurement], order)


def write_bucketed(df: DataFrame, table: str, on: Sequence[str] = KEY, buckets: int = 200) -> DataFrame:
    """A feed as a table bucketed and sorted by its join key; the result reads it.

    Tables of as many buckets on the same key join without moving a row, which pays
    where a feed is joined more often than written. ``container_rows`` comes before
    this for the container feed, since it changes the host.
    """
    df.write.bucketBy(buckets, *on).sortBy(*on).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
