"""Joins of feeds derived from the events, and the unified table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.catalog.rows import APP, APP_NUMBER, CONTAINER_SQL, container_name
from metricweave.functions.times import DAY_NS, floor_to
from metricweave.operators.asof import join_latest
from metricweave.operators.joins import align_feed, join_jobs, join_metrics, join_optional, union_series
from metricweave.plans.unify import FEATURES, HOST_METRICS, container_rows, unify, unify_containers, unify_series
from metricweave.schemas import CPU, MEM, NODE_MANAGER, Feed
from metricweave.session import scratch_path
from metricweave.sources.jdbc import job_history
from metricweave.sources.layout import write_bucketed
from metricweave.sources.series import read_series_json, scan_measurement
from metricweave.streaming.series import series_stream, store_series, stored_points
from metricweave.streaming.unify import unify_stream

SOURCE = "ContainerResource_container_e17_"


def cpu_feed(t: Tables) -> DataFrame:
    """One sample per day and host; weak peaks are missing."""
    rows = scan_measurement(t.points, "click").select(
        "time", "host", F.col("value").alias("cpu_8"), F.col("k").alias("cpu_13"), F.col("value").alias("cpu_14")
    )
    daily = align_feed(rows, DAY_NS, {"cpu_8": "avg", "cpu_13": "avg", "cpu_14": "max"})
    return daily.withColumn("cpu_14", F.when(F.col("cpu_14") >= 20, F.col("cpu_14")))


def mem_feed(t: Tables) -> DataFrame:
    rows = scan_measurement(t.points, "view").select(
        "time", "host", F.col("value").alias("mem_2"), F.col("value").alias("mem_7"), F.col("k").alias("mem_12")
    )
    return align_feed(rows, DAY_NS, {"mem_2": "avg", "mem_7": "min", "mem_12": "max"})


def nm_feed(t: Tables) -> DataFrame:
    """One sample per day, host and container; the host still has its prefix."""
    rows = scan_measurement(t.points, "purchase").select(
        "time",
        F.concat(F.lit("Hostname="), "host").alias("host"),
        container_name(SOURCE).alias("nm_100"),
        *[F.col(c).alias(n) for n, c in {"nm_39": "value", "nm_44": "value", "nm_51": "k", "nm_58": "k"}.items()],
    )
    metrics = {"nm_39": "avg", "nm_44": "max", "nm_51": "max", "nm_58": "min"}
    return align_feed(rows, DAY_NS, metrics, by=("host", "nm_100"))


def jobs_table(t: Tables) -> DataFrame:
    """Customers as job history: value first, application id in position 3."""
    app = F.format_string(f"application_{APP_NUMBER}", "c_custkey")
    return job_history(t.customer.select("c_acctbal", "c_name", "c_mktsegment", app.alias("app")))


FEEDS = f"""
cpu AS (
    SELECT time - time % {DAY_NS} AS time, host, avg(value) AS cpu_8, avg(k) AS cpu_13,
        CASE WHEN max(value) >= 20 THEN max(value) END AS cpu_14
    FROM points WHERE measurement = 'click' GROUP BY 1, 2),
mem AS (
    SELECT time - time % {DAY_NS} AS time, host, avg(value) AS mem_2, min(value) AS mem_7, max(k) AS mem_12
    FROM points WHERE measurement = 'view' GROUP BY 1, 2),
nm AS (
    SELECT time - time % {DAY_NS} AS time, host, {CONTAINER_SQL.format(prefix=SOURCE)} AS source,
        printf('{APP_NUMBER}', {APP}) AS app, avg(value) AS nm_39, max(value) AS nm_44, max(k) AS nm_51, min(k) AS nm_58
    FROM points WHERE measurement = 'purchase' GROUP BY 1, 2, 3, 4),
jobs AS (SELECT printf('{APP_NUMBER}', c_custkey) AS app, c_acctbal AS job_value FROM customer)"""

UNIFY_SQL = with_points(
    FEEDS
    + """
SELECT time, round(cpu_8, 6) AS cpu_8, cpu_13, coalesce(cpu_14, -1) AS cpu_14, round(mem_2, 6) AS mem_2, mem_7, mem_12,
    round(nm_39, 6) AS nm_39, nm_51, nm_58,
    CAST(replace(replace(source, 'ContainerResource_container_e', ''), '_', '') AS DOUBLE) AS container_number,
    CAST(replace(app, '_', '') AS DOUBLE) AS app_number, job_value, CAST(trunc(nm_44) AS INTEGER) AS label
FROM cpu JOIN mem USING (time, host) JOIN nm USING (time, host) JOIN jobs USING (app)"""
)


def unified(t: Tables) -> DataFrame:
    return unify(cpu_feed(t), mem_feed(t), nm_feed(t), jobs_table(t))


@query("unify", UNIFY_SQL)
def _unify(t: Tables):
    rounded = {c: F.round(c, 6) for c in ("cpu_8", "mem_2", "nm_39")}
    return unified(t).withColumns(rounded).select("time", *FEATURES, "label")


def exported(df: DataFrame, name: str, feed: Feed, width: int) -> DataFrame:
    """Feed rows as exported query results: one JSON line per row, every cell in the feed's position."""
    at = {feed.time: "time", feed.host: "host"} | dict(zip(feed.metrics, feed.metric_names()))
    at |= dict(zip(feed.labels, feed.label_names())) | ({feed.tag: "tag"} if feed.tag is not None and feed.tag not in feed.labels else {})
    cells = [F.col(at[i]).cast("string") if i in at else F.lit(None).cast("string") for i in range(width)]
    series = F.struct(F.lit(name).alias("name"), F.array(F.array(*cells)).alias("values"))
    return df.select(F.to_json(F.struct(F.array(F.struct(F.array(series).alias("series"))).alias("results"))).alias("value"))


def rounded_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("cpu_8", "mem_2", "nm_39")}).select("time", *FEATURES, "label")


@query("unify_stream", UNIFY_SQL)
def _unify_stream(t: Tables):
    """The same from three live feeds, joined under a watermark and run to their end."""

    def live(feed: DataFrame, label: str) -> DataFrame:
        path = scratch_path(t.spark, label)
        feed.write.parquet(path)
        return t.spark.readStream.schema(feed.schema).parquet(path)

    rows = unify_stream(live(cpu_feed(t), "cpu"), live(mem_feed(t), "mem"), live(nm_feed(t), "nm"), jobs_table(t))
    out = scratch_path(t.spark, "unified-live")
    run = (
        rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{out}/progress").option("path", f"{out}/rows").start()
    )
    run.awaitTermination()
    return rounded_rows(t.spark.read.schema(rows.schema).parquet(f"{out}/rows"))


@query("unify_bucketed", UNIFY_SQL)
def _unify_bucketed(t: Tables):
    """The same from feeds stored bucketed by time and host, whose joins move no row."""
    feeds = {"cpu": cpu_feed(t), "mem": mem_feed(t), "nm": container_rows(nm_feed(t))}
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    tables = [
        write_bucketed(df, scratch_path(t.spark, name).rpartition("/")[2].replace("-", "_"), buckets=buckets)
        for name, df in feeds.items()
    ]
    return rounded_rows(unify_containers(*tables, jobs_table(t)))


@query("unify_series", UNIFY_SQL)
def _unify_series(t: Tables):
    """The same from exported results, where single cores and other sources stand beside the feeds."""
    path = exported_feeds(t)
    return rounded_rows(unify_series(read_series_json(t.spark, path), jobs_table(t)))


@query("series_stream", UNIFY_SQL)
def _series_stream(t: Tables):
    """The same from results read as a live source, which sets a line that is no result aside."""
    path, out = exported_feeds(t), scratch_path(t.spark, "live")
    t.spark.createDataFrame([('{"results": [',), ('{"error": "timeout"}',)], "value string").write.mode("append").text(path)
    store_series(series_stream(t.spark, path), f"{out}/rows", f"{out}/progress").awaitTermination()
    return rounded_rows(unify_series(stored_points(t.spark, f"{out}/rows"), jobs_table(t)))


def exported_feeds(t: Tables) -> str:
    """The three feeds as exported results, other tags beside them; the folder."""
    tagged = lambda tag: cpu_feed(t).withColumn("tag", F.lit(tag))
    other = nm_feed(t).withColumn("nm_100", F.lit("JvmMetrics"))
    lines = [
        exported(tagged("cpu-total"), "cpu", CPU, 15),
        exported(tagged("cpu0"), "cpu", CPU, 15),
        exported(mem_feed(t), "mem", MEM, 13),
        exported(nm_feed(t), "nodemanager", NODE_MANAGER, 103),
        exported(other, "nodemanager", NODE_MANAGER, 103),
    ]
    path = scratch_path(t.spark, "exported")
    union_series(lines).write.text(path)
    return path


def daily_points(t: Tables, measurement: str) -> DataFrame:
    """Raw points of a measurement with their time cut to the day: keys repeat."""
    return scan_measurement(t.points, measurement).select(
        floor_to(F.col("time"), DAY_NS).alias("time"), "host", "event_id", "value"
    )


POINT_ROWS = f"""
rows AS (SELECT time - time % {DAY_NS} AS time, host, event_id, value FROM points WHERE measurement = 'view')"""


def _joined_sql(kind: str, cpu8: str, cpu13: str) -> str:
    return with_points(
        FEEDS
        + ","
        + POINT_ROWS
        + f"""
SELECT time, host, event_id, value, {cpu8} AS cpu_8, {cpu13} AS cpu_13
FROM rows {kind} JOIN cpu USING (time, host)"""
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("time", "host", "event_id", "value", F.round("cpu_8", 6).alias("cpu_8"), "cpu_13")


@query("join_metrics", _joined_sql("INNER", "round(cpu_8, 6)", "cpu_13"))
def _inner(t: Tables):
    return _rounded(join_metrics(daily_points(t, "view"), cpu_feed(t)))


@query("join_left", _joined_sql("LEFT", "round(cpu_8, 6)", "cpu_13"))
def _left(t: Tables):
    return _rounded(join_metrics(daily_points(t, "view"), cpu_feed(t), how="left"))


@query("join_salted", _joined_sql("LEFT", "round(cpu_8, 6)", "cpu_13"))
def _salted(t: Tables):
    """The left join with hot keys spread, on a left side that was joined on the same key before."""
    rows = daily_points(t, "view")
    known = rows.select("time", "host").distinct()
    return _rounded(join_metrics(rows.join(known, ["time", "host"]), cpu_feed(t), how="left", salts=8))


@query("join_optional", _joined_sql("LEFT", "round(coalesce(cpu_8, 0), 6)", "coalesce(cpu_13, 0)"))
def _optional(t: Tables):
    return _rounded(join_optional(daily_points(t, "view"), cpu_feed(t)))


@query(
    "join_hosts",
    with_points(
        FEEDS
        + """
SELECT time, host, round(cpu_8, 6) AS cpu_8, cpu_13, cpu_14, round(mem_2, 6) AS mem_2, mem_7, mem_12
FROM cpu JOIN mem USING (time, host)"""
    ),
)
def _hosts(t: Tables):
    hosts = join_metrics(cpu_feed(t), mem_feed(t))
    rounded = {c: F.round(c, 6) for c in ("cpu_8", "mem_2")}
    return hosts.withColumns(rounded).select("time", "host", *HOST_METRICS)


@query(
    "join_jobs",
    with_points(
        f"""SELECT event_id, value, 'application_' || printf('{APP_NUMBER}', c_custkey) AS app_id, c_acctbal AS job_value
        FROM points JOIN customer ON c_custkey = {APP}"""
    ),
)
def _jobs(t: Tables):
    app = F.format_string(f"application_{APP_NUMBER}", F.expr(APP))
    rows = t.points.select("event_id", "value", app.alias("app_id"))
    return join_jobs(rows, jobs_table(t)).select("event_id", "value", "app_id", "job_value")


# Three days, in nanoseconds: how old a view may be to count for a click.
TOLERANCE = 3 * DAY_NS
LATEST_SQL = """clicks AS (SELECT event_id, time, host, value FROM points WHERE measurement = 'click'),
views AS (SELECT time AS seen, host, event_id AS view_id, k AS view_k FROM points WHERE measurement = 'view')"""


@query(
    "join_latest",
    with_points(
        LATEST_SQL
        + f""" SELECT event_id, time, c.host, value, CASE WHEN time - seen <= {TOLERANCE} THEN view_id END AS view_id,
            CASE WHEN time - seen <= {TOLERANCE} THEN view_k END AS view_k, CASE WHEN time - seen <= {TOLERANCE} THEN seen END AS view_time
        FROM clicks c ASOF LEFT JOIN views v ON c.host = v.host AND c.time >= v.seen"""
    ),
)
def _latest_view(t: Tables):
    """Each click with its host's last view of at most three days before."""
    clicks = scan_measurement(t.points, "click").select("event_id", "time", "host", "value")
    views = scan_measurement(t.points, "view").select(
        "time", "host", F.col("event_id").alias("view_id"), F.col("k").alias("view_k")
    )
    return join_latest(clicks, views, tolerance=TOLERANCE, right_time="view_time")


@query(
    "join_latest_feed",
    with_points(
        LATEST_SQL
        + """ SELECT event_id, time, 'all' AS feed, view_id, view_k
        FROM clicks c ASOF JOIN views v ON c.time >= v.seen"""
    ),
)
def _latest_feed(t: Tables):
    """One key holds every row: all clicks against the last view of the whole feed."""
    feed = F.lit("all").alias("feed")
    clicks = scan_measurement(t.points, "click").select("event_id", "time", feed)
    views = scan_measurement(t.points, "view").select("time", feed, F.col("event_id").alias("view_id"), F.col("k").alias("view_k"))
    return join_latest(clicks, views, by=["feed"], how="inner")
