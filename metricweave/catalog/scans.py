"""Scans of stored measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.functions.times import DAY_NS, timestamp_to_epoch
from metricweave.operators.grouping import column_std, group_series, row_count
from metricweave.operators.joins import union_series
from metricweave.session import scratch_path
from metricweave.sources.layout import scan_stored, write_measurements
from metricweave.sources.series import first_n_per_series, scan_measurement, scan_measurements

# 2024-01-05 and 2024-01-20, in epoch nanoseconds
AFTER, BEFORE = 19727 * DAY_NS, 19742 * DAY_NS


@query(
    "scan_measurement",
    with_points(
        f"""SELECT event_id, time, host, value FROM points
        WHERE measurement = 'click' AND regexp_matches(host, '7') AND time > {AFTER} AND time < {BEFORE}"""
    ),
)
def _scan(t: Tables):
    """Bounds in the type of the stored column, so that they reach the file scan."""
    stored = t.events.withColumn("host", F.col("user_id").cast("string"))
    bound = lambda ns: F.lit(ns // 1000).cast("bigint")
    after, before = (F.timestamp_micros(bound(x)).cast("timestamp_ntz") for x in (AFTER, BEFORE))
    found = scan_measurement(stored, "click", {"host": "7"}, after, before, measurement="event_type", time="ts")
    return found.select("event_id", timestamp_to_epoch(F.col("ts")).alias("time"), "host", "value")


@query(
    "scan_tag_patterns",
    with_points(
        """SELECT event_id, measurement, host FROM points
        WHERE regexp_matches(measurement, '^p|w$') AND regexp_matches(measurement, 'e') AND regexp_matches(host, '^1')"""
    ),
)
def _patterns(t: Tables):
    found = scan_measurement(t.points, tags={"measurement": ["^p|w$", "e"], "host": "^1"})
    return found.select("event_id", "measurement", "host")


@query(
    "latest_points",
    with_points(
        """SELECT event_id, time, host, measurement, value FROM points
        WHERE regexp_matches(measurement, '^cl') ORDER BY time DESC, event_id DESC LIMIT 100"""
    ),
)
def _latest(t: Tables):
    found = scan_measurement(
        t.points, tags={"measurement": "^cl"}, newest_first=True, limit=100, ties=["event_id"]
    )
    return found.select("event_id", "time", "host", "measurement", "value")


@query(
    "latest_many",
    with_points("SELECT event_id, time, value FROM points ORDER BY time DESC, event_id DESC LIMIT 1500"),
)
def _latest_many(t: Tables):
    """A limit of more than a thousand rows."""
    found = scan_measurement(t.points, newest_first=True, limit=1500, ties=["event_id"])
    return found.select("event_id", "time", "value")


@query(
    "scan_measurements_limit",
    with_points(
        """SELECT event_id, measurement, time, value FROM points
        WHERE measurement = 'purchase' OR regexp_matches(measurement, '^cl') OR regexp_matches(measurement, 'ew$')
        QUALIFY row_number() OVER (PARTITION BY measurement ORDER BY time, event_id) <= 3"""
    ),
)
def _named(t: Tables):
    found = scan_measurements(
        t.points, patterns=["^cl", "ew$"], exact=["purchase"], per_series_limit=3, order=["time", "event_id"]
    )
    return found.select("event_id", "measurement", "time", "value")


@query(
    "scan_measurements",
    with_points(
        """SELECT event_id, measurement, value FROM points
        WHERE measurement = 'purchase' OR regexp_matches(measurement, '^cl')"""
    ),
)
def _named_all(t: Tables):
    return scan_measurements(t.points, ["^cl"], ["purchase"]).select("event_id", "measurement", "value")


@query(
    "scan_stored",
    with_points(
        f"""SELECT event_id, measurement, time, value FROM points
        WHERE (measurement = 'purchase' OR regexp_matches(measurement, '^cl')) AND time > {AFTER} AND time < {BEFORE}"""
    ),
)
def _stored(t: Tables):
    """Names by pattern and a time range on the stored layout, where both choose the folders that are read."""
    path = scratch_path(t.spark, "measurements")
    write_measurements(t.points.select("event_id", "measurement", "time", "value"), path)
    found = scan_stored(t.spark, path, ["^cl"], ["purchase"], AFTER, BEFORE)
    return found.select("event_id", "measurement", "time", "value")


@query(
    "first_per_host",
    with_points(
        """SELECT event_id, measurement, host, time FROM points
        QUALIFY row_number() OVER (PARTITION BY measurement, host ORDER BY time, event_id) <= 3"""
    ),
)
def _first(t: Tables):
    found = first_n_per_series(t.points, 3, ["measurement", "host"], ["time", "event_id"])
    return found.select("event_id", "measurement", "host", "time")


@query(
    "union_series",
    with_points(
        """SELECT event_id, time, host, value FROM points WHERE measurement = 'click'
        UNION ALL SELECT event_id, time, host, value FROM points WHERE measurement = 'view'
        UNION ALL SELECT event_id, time, host, value FROM points WHERE measurement = 'view'"""
    ),
)
def _union(t: Tables):
    columns = ["event_id", "time", "host", "value"]
    click, view = (scan_measurement(t.points, m).select(*columns) for m in ("click", "view"))
    return union_series([click, view, view])


@query(
    "group_series",
    """SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
    FROM lineitem GROUP BY ALL""",
)
def _groups(t: Tables):
    totals = [F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("line_numbers")]
    return group_series(t.lineitem, ["flag$", "status$"], totals)


@query("group_series_rows", "SELECT event_type, count(*) AS rows FROM events GROUP BY ALL")
def _group_rows(t: Tables):
    return group_series(t.events, ["type"])


@query("row_count", with_points("SELECT measurement, count(*) AS rows FROM points GROUP BY measurement"))
def _count(t: Tables):
    return row_count(t.points, ["measurement"])


@query(
    "column_std",
    with_points(
        """SELECT measurement, round(stddev_pop(value), 6) AS value_std, round(stddev_pop(k), 6) AS k_std
        FROM points GROUP BY measurement"""
    ),
)
def _std(t: Tables):
    deviations = column_std(t.points, ["value", "k"], ["measurement"])
    return deviations.select("measurement", *[F.round(c, 6).alias(c) for c in ("value_std", "k_std")])
