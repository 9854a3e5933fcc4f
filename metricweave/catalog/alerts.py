"""Heartbeat checks, stored and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.functions.times import DAY_NS, UNIT_NS, floor_to, timestamp_to_epoch
from metricweave.operators.alerts import deadman, state_changes_only, with_message
from metricweave.session import scratch_path
from metricweave.streaming.deadman import deadman_stream, emitted_stream

HOUR_NS = UNIT_NS["h"]


def _levels(threshold: int) -> str:
    return f"""cells AS (SELECT measurement, time - time % {HOUR_NS} AS slot FROM points),
slots AS (SELECT unnest(generate_series(min(slot), max(slot), {HOUR_NS})) AS slot FROM cells),
grid AS (SELECT measurement, slot FROM (SELECT DISTINCT measurement FROM cells) CROSS JOIN slots),
counts AS (SELECT measurement, slot, count(*) AS n FROM cells GROUP BY ALL),
levels AS (
    SELECT measurement, slot, coalesce(n, 0) AS emitted,
        CASE WHEN coalesce(n, 0) <= {threshold} THEN 'CRITICAL' ELSE 'OK' END AS level
    FROM grid LEFT JOIN counts USING (measurement, slot))"""


def hourly(t: Tables, threshold: float) -> DataFrame:
    return deadman(t.points, ["measurement"], interval=HOUR_NS, threshold=threshold)


@query("deadman", with_points(_levels(0) + " SELECT * FROM levels"))
def _deadman(t: Tables):
    return hourly(t, 0)


@query("deadman_threshold", with_points(_levels(1) + " SELECT * FROM levels WHERE level = 'CRITICAL'"))
def _threshold(t: Tables):
    return hourly(t, 1).where(F.col("level") == "CRITICAL")


@query(
    "deadman_messages",
    with_points(
        _levels(0)
        + """, named AS (SELECT *, 'measurement=' || measurement || ':NODE_NAME for task ''events''' AS id FROM levels)
        SELECT id, slot, level, printf('%s is %s: %.3f points/INTERVAL.', id,
            CASE WHEN level = 'OK' THEN 'alive' ELSE 'dead' END, CAST(emitted AS DOUBLE)) AS message FROM named"""
    ),
)
def _messages(t: Tables):
    return with_message(hourly(t, 0), ["measurement"], "events").select("id", "slot", "level", "message")


CHANGED = """ SELECT measurement, slot, emitted, level FROM levels
QUALIFY level IS DISTINCT FROM lag(level) OVER (PARTITION BY measurement ORDER BY slot)"""


@query("state_changes", with_points(_levels(1) + CHANGED))
def _changes(t: Tables):
    return state_changes_only(hourly(t, 1), ["measurement"], ["slot"])


@query(
    "state_changes_points",
    with_points(
        """marked AS (SELECT event_id, measurement, time, CASE WHEN value > 50 THEN 'CRITICAL' ELSE 'OK' END AS level FROM points)
        SELECT event_id, measurement, time, level FROM marked
        QUALIFY level IS DISTINCT FROM lag(level) OVER (PARTITION BY measurement ORDER BY time, event_id)"""
    ),
)
def _changes_points(t: Tables):
    """Level changes on raw points; a measurement is compared in as many pieces as it needs."""
    level = F.when(F.col("value") > 50, "CRITICAL").otherwise("OK")
    marked = t.points.select("event_id", "measurement", "time", level.alias("level"))
    return state_changes_only(marked, ["measurement"], ["time", "event_id"])


def streamed(t: Tables, alerts, label: str) -> DataFrame:
    """Run a stream over the stored events to its end; the output is a table in the shared folder."""
    feed = (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    out = scratch_path(t.spark, label)
    run = (
        alerts(feed)
        .withColumn("slot", timestamp_to_epoch(F.col("slot")))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/progress")
        .option("path", f"{out}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


# The watermark of a finished stream: the newest point, in whole milliseconds.
CLOSED = f"""cells AS (SELECT measurement, time - time % {HOUR_NS} AS slot FROM points),
mark AS (SELECT max(time) - max(time) % 1000000 AS watermark FROM points),
counts AS (SELECT measurement AS event_type, slot, count(*) AS n FROM cells GROUP BY ALL),
slots AS (
    SELECT event_type, unnest(generate_series(min(slot), (SELECT watermark FROM mark) - {HOUR_NS}, {HOUR_NS})) AS slot
    FROM counts GROUP BY event_type),
levels AS (
    SELECT event_type, slot, coalesce(n, 0) AS emitted,
        CASE WHEN coalesce(n, 0) <= 0 THEN 'CRITICAL' ELSE 'OK' END AS level
    FROM slots LEFT JOIN counts USING (event_type, slot))"""


@query("deadman_stream", with_points(CLOSED + " SELECT event_type, slot, emitted, level FROM levels"))
def _stream(t: Tables):
    return streamed(t, lambda feed: deadman_stream(feed, ["event_type"], "ts", "1 hour"), "deadman")


@query(
    "deadman_stream_changes",
    with_points(
        CLOSED
        + """ SELECT event_type, slot, emitted, level FROM levels
        QUALIFY level IS DISTINCT FROM lag(level) OVER (PARTITION BY event_type ORDER BY slot)"""
    ),
)
def _stream_changes(t: Tables):
    return streamed(
        t, lambda feed: deadman_stream(feed, ["event_type"], "ts", "1 hour", changes_only=True), "deadman-changes"
    )


@query("emitted_stream", with_points(CLOSED + " SELECT event_type, slot, emitted FROM levels WHERE emitted > 0"))
def _emitted(t: Tables):
    return streamed(t, lambda feed: emitted_stream(feed, ["event_type"], "ts", "1 hour"), "emitted")
