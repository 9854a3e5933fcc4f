"""File formats: a table is written in the format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricweave.catalog.registry import Tables, query, with_points
from metricweave.operators.joins import union_series
from metricweave.operators.projection import project_positions, split_label
from metricweave.schemas import TRAINING_LABEL, TRAINING_SLICES, Feed
from metricweave.session import scratch_path
from metricweave.sources.csv import read_labelled_csv, read_rows_csv, write_rows_csv
from metricweave.sources.series import feed_rows, points_to_rows, read_points_json, read_series_json

CHUNK = 1000


@query(
    "series_json",
    with_points("SELECT measurement, time, host, value AS event_3, CASE WHEN k < 90 THEN k END AS event_4 FROM points"),
)
def _series(t: Tables):
    """Query results in chunks of at most a thousand points, as the query API delivers them."""
    cell = F.concat_ws(
        ",",
        F.col("time").cast("string"),
        F.concat(F.lit('"'), "measurement", F.lit('"')),
        F.concat(F.lit('"'), "host", F.lit('"')),
        F.col("value").cast("string"),
        F.when(F.col("k") < 90, F.col("k").cast("string")).otherwise("null"),
    )
    rows = t.points.select(
        "measurement", F.expr(f"event_id div {CHUNK}").alias("chunk"), F.concat(F.lit("["), cell, F.lit("]")).alias("row")
    )
    # event_id is unique, so a chunk holds at most CHUNK rows
    chunks = rows.groupBy("measurement", "chunk").agg(F.concat_ws(",", F.collect_list("row")).alias("rows"))
    result = F.format_string(
        '{"results":[{"series":[{"name":"%s","columns":["time","type","host","value","k"],"values":[%s]}]}]}',
        "measurement",
        "rows",
    )
    path = scratch_path(t.spark, "series")
    chunks.select(result.alias("value")).write.text(path)
    feed = Feed("event", time=0, host=2, metrics=(3, 4), labels=(1,))
    points = read_series_json(t.spark, path)
    names = [r["name"] for r in points.select("name").distinct().collect()]
    every = union_series([feed_rows(points, name, feed) for name in names])
    return every.withColumnRenamed("event_1", "measurement")


@query(
    "points_json",
    with_points(
        """SELECT measurement, host, time + event_id % 1000 AS time_ns, unnest(['value', 'k', 'status']) AS field,
            unnest([value, k, NULL]) AS value, unnest([NULL, NULL, 'at ' || host]) AS text FROM points"""
    ),
)
def _points(t: Tables):
    """Numbers and a text in one point, and times finer than a timestamp."""
    exact = F.col("time") + F.col("event_id") % 1000
    second = F.date_format(F.timestamp_seconds(F.expr("time div 1000000000")), "yyyy-MM-dd'T'HH:mm:ss")
    nested = t.points.select(
        "measurement",
        F.create_map(F.lit("host"), F.col("host")).alias("tags"),
        F.concat(second, F.lit("."), F.lpad((exact % 1_000_000_000).cast("string"), 9, "0"), F.lit("Z")).alias("time"),
        F.struct("value", "k", F.concat(F.lit("at "), "host").alias("status")).alias("fields"),
    )
    path = scratch_path(t.spark, "points")
    nested.write.json(path)
    rows = points_to_rows(read_points_json(t.spark, path))
    return rows.select("measurement", F.col("tags")["host"].alias("host"), "time_ns", "field", "value", "text")


@query(
    "csv_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority
    FROM orders""",
)
def _csv(t: Tables):
    """Every column as text and back; times as they are spelt by default."""
    path = scratch_path(t.spark, "rows")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    write_rows_csv(t.orders.select(names), path)
    back = read_rows_csv(t.spark, path, len(names)).toDF(*names)
    types = dict(t.orders.dtypes)
    typed = back.select(*[F.col(c).cast(types[c]).alias(c) for c in names])
    return typed.withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


LABELLED = ["l_quantity", "l_discount", "l_tax"]


@query(
    "csv_labelled",
    """SELECT CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_discount AS FLOAT) AS l_discount,
        CAST(l_tax AS FLOAT) AS l_tax, l_linenumber FROM lineitem""",
)
def _labelled(t: Tables):
    path = scratch_path(t.spark, "labelled")
    write_rows_csv(t.lineitem.select(*LABELLED, "l_linenumber"), path, header=True)
    return read_labelled_csv(t.spark, path, LABELLED, "l_linenumber")


@query(
    "csv_training",
    """SELECT CAST(l_orderkey AS DOUBLE) AS f_1, CAST(l_partkey AS DOUBLE) AS f_2, CAST(l_suppkey AS DOUBLE) AS f_3,
        CAST(l_linenumber AS DOUBLE) AS f_4, l_discount AS f_6, l_tax AS f_7, l_quantity AS f_8, l_extendedprice AS f_10,
        l_tax AS f_12, l_discount AS f_15, CAST(trunc(l_extendedprice / 100) AS INTEGER) AS label
    FROM lineitem""",
)
def _training(t: Tables):
    """Sixteen text columns; features, label and an unused column are picked by position."""
    cells = [
        "l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_discount", "l_tax",
        "l_quantity", "target", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_discount",
    ]
    path = scratch_path(t.spark, "training")
    lines = t.lineitem.withColumn("target", F.col("l_extendedprice") / 100)
    write_rows_csv(lines.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cells)]), path)

    rows = read_rows_csv(t.spark, path, len(cells)).select(F.array("*").alias("values"))
    picked = project_positions(rows, TRAINING_SLICES, prefix="f_")
    features = picked.columns[:10]
    numbers = picked.withColumns({c: F.col(c).cast("double") for c in features})
    return split_label(numbers, f"f_{TRAINING_LABEL}", features)
