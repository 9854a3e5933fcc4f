"""Time-series results: exported query results, points, and measurement scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from metricweave.functions.predicates import tag_matches, time_between
from metricweave.schemas import POINT, SERIES_RESULT, Feed


def read_series_json(
    spark: SparkSession, path: str, pretty: bool = False, allow_partial: bool = False
) -> DataFrame:
    """Exported query results, one JSON object per line → ``name, tags, columns, values``.

    One output row per point; ``values`` keeps the cells as text in source
    order, since a result mixes numbers and strings. Lines are the unit of
    parallelism: exports should be chunked, as the query API does. ``pretty``
    reads files that hold one object over several lines, each file in one task.

    Nothing is passed over: a line that is no JSON, a result that reports an
    error, and a result cut short (unless ``allow_partial``) stop the read.
    """
    reader = spark.read.schema(SERIES_RESULT).option("mode", "FAILFAST").option("multiLine", pretty)
    lines = reader.json(path)
    series, fault = judged_result(F.col("results"), F.col("error"), allow_partial)
    found = lines.select(F.inline(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(series)))
    return found.select("name", "tags", "columns", F.explode("values").alias("values"))


_SERIES = SERIES_RESULT["results"].dataType.elementType["series"].dataType


def judged_result(results: Column, error: Column, allow_partial: bool = False) -> tuple[Column, Column]:
    """All series of a query result, and what is wrong with it (null: nothing)."""
    results = F.coalesce(results, F.array().cast(SERIES_RESULT["results"].dataType))
    errors = F.concat(F.array(error), F.transform(results, lambda r: r["error"]))
    told = F.array_join(F.array_compact(errors), "; ")
    series = F.flatten(F.transform(results, lambda r: F.coalesce(r["series"], F.array().cast(_SERIES))))
    cut = F.exists(results, lambda r: F.coalesce(r["partial"], F.lit(False))) | F.exists(
        series, lambda s: F.coalesce(s["partial"], F.lit(False))
    )
    fault = F.when(told != "", F.concat(F.lit("query result with an error: "), told))
    if not allow_partial:
        fault = fault.when(cut, F.lit("query result was cut short"))
    return series, fault


def feed_rows(points: DataFrame, measurement: str, feed: Feed, tags: Sequence[str] = ()) -> DataFrame:
    """Positional points of one measurement → ``time, host, <prefix>_<position>…``.

    A row shorter than a position gives null there. A feed with a tag position
    takes only rows whose tag matches its pattern. ``tags`` names labels to be
    taken from the ``tags`` map, where grouped results carry them.
    """
    cell = lambda position: F.get("values", F.lit(position))
    rows = points.where(F.col("name") == measurement)
    if feed.tag is not None:
        rows = rows.where(tag_matches(cell(feed.tag), feed.pattern))
    return rows.select(
        cell(feed.time).try_cast("bigint").alias("time"),
        cell(feed.host).alias("host"),
        *[cell(p).try_cast("double").alias(n) for p, n in zip(feed.metrics, feed.metric_names())],
        *[cell(p).alias(n) for p, n in zip(feed.labels, feed.label_names())],
        *[F.col("tags")[tag].alias(tag) for tag in tags],
    )


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT).option("mode", "FAILFAST").json(path)


def points_to_rows(points: DataFrame) -> DataFrame:
    """Nested points → one row per field: ``measurement, tags, time, time_ns, field, value, text``.

    ``value`` is the number of a numeric field; any other field keeps its
    ``text``. ``time_ns`` has all nine digits of the time, which the timestamp has not.
    """
    time = F.col("time")
    fraction = F.regexp_extract(time, r"\.([0-9]{1,9})", 1)
    second = F.unix_seconds(F.to_timestamp(F.regexp_replace(time, r"\.[0-9]+", "")))
    exact = second * F.lit(1_000_000_000).cast("bigint") + F.rpad(fraction, 9, "0").cast("bigint")
    rows = points.select(
        "measurement",
        "tags",
        F.to_timestamp(F.regexp_replace(time, r"(\.[0-9]{6})[0-9]+", "$1")).alias("time"),
        exact.alias("time_ns"),
        F.explode("fields").alias("field", "_cell"),
    )
    value = F.col("_cell").try_cast("double")
    return rows.withColumns({"value": value, "text": F.when(value.isNull(), F.col("_cell"))}).drop("_cell")


def scan_measurement(
    df: DataFrame,
    name: str | None = None,
    tags: Mapping[str, str | Sequence[str]] | None = None,
    after: Column | int | None = None,
    before: Column | int | None = None,
    newest_first: bool = False,
    limit: int | None = None,
    measurement: str = "measurement",
    time: str = "time",
    ties: Sequence[str] = (),
) -> DataFrame:
    """All columns of one measurement, filtered by tag patterns and an open time range.

    The equality on ``measurement`` prunes partitions of a table partitioned by
    it; patterns cannot. ``ties`` orders points of one instant, so that a limit
    is repeatable.
    """
    keep = time_between(F.col(time), after, before)
    if name is not None:
        keep = (F.col(measurement) == name) & keep
    for tag, patterns in (tags or {}).items():
        keep = keep & tag_matches(F.col(tag), *([patterns] if isinstance(patterns, str) else patterns))
    out = df.where(keep)
    if newest_first:
        out = latest_first(out, time, ties)
    elif limit is not None:
        out = out.orderBy(time, *ties)
    return out if limit is None else out.limit(limit)


def latest_first(df: DataFrame, time: str = "time", ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties])


def scan_measurements(
    df: DataFrame,
    patterns: Sequence[str] = (),
    exact: Sequence[str] = (),
    per_series_limit: int | None = None,
    measurement: str = "measurement",
    order: Sequence[str] = ("time",),
) -> DataFrame:
    """Measurements named exactly or by pattern, with an optional row limit per series."""
    keep = F.lit(False)
    if exact:
        keep = F.col(measurement).isin(*exact)
    for pattern in patterns:
        keep = keep | tag_matches(F.col(measurement), pattern)
    out = df.where(keep)
    if per_series_limit is None:
        return out
    return first_n_per_series(out, per_series_limit, [measurement], order)


def first_n_per_series(df: DataFrame, n: int, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each series.

    Spark turns the filtered ``row_number`` into a group limit that runs before
    the shuffle as well, so a series holding most of the rows sends at most
    ``n`` of them per map task.
    """
    window = Window.partitionBy(*series).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")
