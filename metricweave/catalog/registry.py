"""Registration of queries and access to their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricweave.functions.times import timestamp_to_epoch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def points(self) -> DataFrame:
        """Events as metric points: the event type is the measurement, the user the host."""
        return self.events.select(
            "event_id",
            timestamp_to_epoch(F.col("ts")).alias("time"),
            F.col("user_id").cast("string").alias("host"),
            F.col("event_type").alias("measurement"),
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
        )


# The same view of the events for the SQL side.
POINTS = """points AS (
    SELECT event_id, epoch_ns(ts) AS time, CAST(user_id AS VARCHAR) AS host, event_type AS measurement,
           value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
    FROM events)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` may start with ``points`` to use that view."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # epoch arithmetic and calendar functions must agree on the zone
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def with_points(body: str) -> str:
    """Prefix a query, or its further ``name AS (…)`` parts, with the points view."""
    body = body.strip()
    return f"WITH {POINTS}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
