"""Row-wise operators: positions, missing values, keys, labels and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.functions import ids
from metricweave.functions.numeric import clamp_allocation, relu, sigmoid
from metricweave.functions.paths import metric_path
from metricweave.functions.times import epoch_to_timestamp, timestamp_to_epoch
from metricweave.operators.projection import (
    drop_last,
    fill_missing,
    project_positions,
    rekey,
    split_label,
    with_key,
)

# one application per host and tenth of k, as the job history has ten per host
APP = "CAST(host AS BIGINT) * 10 + CAST(k AS BIGINT) % 10"
APP_NUMBER = "1704067200000_%04d"
CONTAINER_TAIL = "_01_%06d"


def container_name(prefix: str):
    """The container a point came from, spelled as the node manager does."""
    return F.format_string(
        f"{prefix}{APP_NUMBER}{CONTAINER_TAIL}", F.expr(APP), F.expr("CAST(k AS BIGINT) div 10")
    )


CONTAINER_SQL = f"printf('{{prefix}}{APP_NUMBER}{CONTAINER_TAIL}', {APP}, CAST(k AS BIGINT) // 10)"


@query(
    "positions",
    """SELECT CAST(l_orderkey AS VARCHAR) AS c0, l_partkey AS p_1, l_suppkey AS p_2, l_linenumber AS p_3,
        l_returnflag AS p_6, l_linestatus AS p_7, CAST(NULL AS VARCHAR) AS p_8, l_partkey AS p_1_again
    FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
        CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem)""",
)
def _positions(t: Tables):
    cells = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    row = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("c0"),
        # two cells of padding, so positions 6 to 8 cross the end of the row
        F.array(*[F.col(c).cast("string") for c in [*cells[:4], cells[3], cells[3], *cells[4:]]]).alias("values"),
    )
    return project_positions(row, [(1, 4), (6, 9)], prefix="p_").withColumn("p_1_again", F.col("p_1"))


@query(
    "fill_missing",
    with_points(
        """SELECT event_id, coalesce(CASE WHEN value <= 50 THEN value END, -1) AS value,
            coalesce(CASE WHEN k < 50 THEN host END, '-1') AS host FROM points"""
    ),
)
def _fill(t: Tables):
    holes = t.points.select(
        "event_id",
        F.when(F.col("value") <= 50, F.col("value")).alias("value"),
        F.when(F.col("k") < 50, F.col("host")).alias("host"),
    )
    return fill_missing(holes)


@query(
    "fill_zero",
    with_points("SELECT event_id, coalesce(CASE WHEN value <= 50 THEN value END, 0) AS value FROM points"),
)
def _fill_zero(t: Tables):
    holes = t.points.select("event_id", F.when(F.col("value") <= 50, F.col("value")).alias("value"))
    return fill_missing(holes, 0, ["value"])


@query(
    "keyed_points",
    """SELECT event_type, epoch_ns(ts) AS time, user_id AS host, event_id, value FROM events""",
)
def _keyed(t: Tables):
    points = t.events.select(
        "event_id", "event_type", timestamp_to_epoch(F.col("ts")).alias("ts"), "user_id", "value"
    )
    return rekey(with_key(points, "ts", "user_id"), "event_type")


@query(
    "split_label",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax,
        CAST(trunc(l_extendedprice / 7) AS INTEGER) AS label FROM lineitem""",
)
def _label(t: Tables):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 7)
    return split_label(rows, "target", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "drop_last",
    """SELECT event_id, value FROM events WHERE event_id < (SELECT max(event_id) FROM events)""",
)
def _drop_last(t: Tables):
    return drop_last(t.events.select("event_id", "value"), ["event_id"])


@query(
    "container_ids",
    with_points(
        f"""SELECT event_id, 'application_' || number AS app_id, CAST(replace(number, '_', '') AS DOUBLE) AS app_number,
            CAST(CAST(replace(number, '_', '') AS HUGEINT) AS VARCHAR) AS app_exact,
            CAST(replace(replace(source, 'ContainerResource_container_e', ''), '_', '') AS DOUBLE) AS container_number,
            replace(replace(source, 'ContainerResource_container_e', ''), '_', '') AS container_exact
        FROM (SELECT event_id, printf('{APP_NUMBER}', {APP}) AS number,
            {CONTAINER_SQL.format(prefix='ContainerResource_container_e17_')} AS source FROM points)"""
    ),
)
def _container_ids(t: Tables):
    source = container_name("ContainerResource_container_e17_")
    named = t.points.select("event_id", source.alias("source"), ids.app_id_from_container(source).alias("app_id"))
    app, container = F.col("app_id"), F.col("source")
    return named.select(
        "event_id",
        "app_id",
        ids.app_id_number(app).alias("app_number"),
        ids.app_id_number(app, exact=True).cast("string").alias("app_exact"),
        ids.container_id_number(container).alias("container_number"),
        ids.container_id_number(container, exact=True).cast("string").alias("container_exact"),
    )


@query(
    "container_ids_unmatched",
    with_points("SELECT event_id, CAST(NULL AS VARCHAR) AS app_id, CAST(NULL AS DOUBLE) AS app_number FROM points"),
)
def _unmatched(t: Tables):
    return t.points.select(
        "event_id",
        ids.app_id_from_container(F.concat(F.lit("jvm_"), F.col("host"))).alias("app_id"),
        ids.app_id_number(F.concat(F.lit("application_x"), F.col("host"))).alias("app_number"),
    )


@query("strip_host", with_points("SELECT event_id, host FROM points"))
def _strip(t: Tables):
    return t.points.select("event_id", ids.strip_host_prefix(F.concat(F.lit("Hostname="), F.col("host"))).alias("host"))


@query(
    "metric_path",
    with_points(
        """SELECT event_id, 'nodemanager.jvm' AS prefix, host, measurement AS context,
            'Gauge' || CAST(CAST(k AS BIGINT) AS VARCHAR) AS leaf FROM points"""
    ),
)
def _path(t: Tables):
    name = F.concat(
        F.lit("nodemanager.jvm.Context="), "measurement", F.lit(".Hostname="), "host",
        F.lit(".Gauge"), F.col("k").cast("bigint").cast("string"),
    )
    parts = t.points.select("event_id", metric_path(name).alias("path"))
    return parts.select(
        "event_id",
        "path.prefix",
        F.col("path.tags")["Hostname"].alias("host"),
        F.col("path.tags")["Context"].alias("context"),
        "path.leaf",
    )


@query(
    "epoch_time",
    """SELECT event_id, epoch_ns(ts) AS time_ns, epoch_ns(ts) // 1000000 AS time_ms, CAST(floor(epoch(ts)) AS BIGINT) AS time_s,
        ts AS from_ns, date_trunc('millisecond', ts) AS from_ms, date_trunc('second', ts) AS from_s,
        date_trunc('hour', ts) AS from_h
    FROM events""",
)
def _epoch(t: Tables):
    ts = F.col("ts")
    epochs = t.events.select(
        "event_id", *[timestamp_to_epoch(ts, u).alias(f"time_{u}") for u in ("ns", "ms", "s", "h")]
    )
    return epochs.select(
        "event_id", "time_ns", "time_ms", "time_s",
        *[epoch_to_timestamp(F.col(f"time_{u}"), u).cast("timestamp_ntz").alias(f"from_{u}") for u in ("ns", "ms", "s", "h")],
    )


@query(
    "activations",
    with_points(
        """SELECT event_id, greatest((value - 50) / 10, 0) AS relu,
            round(1 / (1 + exp(-((value - 50) / 10))), 9) AS sigmoid FROM points"""
    ),
)
def _activations(t: Tables):
    x = (F.col("value") - 50) / 10
    return t.points.select("event_id", relu(x).alias("relu"), F.round(sigmoid(x), 9).alias("sigmoid"))


@query(
    "clamp_allocation",
    """SELECT l_orderkey, l_linenumber, l_quantity, least(greatest(l_quantity * 60, 128), 2500) AS memory_mb,
        CAST(least(greatest(l_linenumber - 1, 1), 4) AS DOUBLE) AS vcores FROM lineitem""",
)
def _clamp(t: Tables):
    granted = clamp_allocation(F.col("l_quantity") * 60, (F.col("l_linenumber") - 1).cast("double"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", granted.alias("granted")
    ).select("l_orderkey", "l_linenumber", "l_quantity", "granted.memory_mb", "granted.vcores")
