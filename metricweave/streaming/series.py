"""Exported query results as a live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from metricweave.schemas import SERIES_RESULT
from metricweave.sources.series import judged_result

POINT, REJECTED = "point", "rejected"
BAD_LINE = "line is no query result"
_UNREAD = "_unread"
_ROW = "name string, tags map<string,string>, columns array<string>, values array<string>, line string, error string, kind string"
_ENTRY = "array<struct<name:string,tags:map<string,string>,columns:array<string>,values:array<string>>>"


def parse_lines(lines: DataFrame, allow_partial: bool = False) -> DataFrame:
    """``kind, name, tags, columns, values, line, error`` from a column ``value`` of result lines.

    A good line gives one row per point, as the stored read does. A line that is no
    JSON object, reports an error, or was cut short (unless ``allow_partial``) gives
    one row of kind ``rejected`` with the line and the reason, and stops nothing. An
    empty line gives no row.
    """
    schema = T.StructType([*SERIES_RESULT.fields, T.StructField(_UNREAD, T.StringType())])
    told = lines.where(F.trim("value") != "").select(
        "value", F.from_json("value", schema, {"columnNameOfCorruptRecord": _UNREAD}).alias("told")
    )
    series, fault = judged_result(F.col("told.results"), F.col("told.error"), allow_partial)
    unread = F.col(f"told.{_UNREAD}").isNotNull() | ~F.trim("value").startswith("{")
    error = F.when(unread, F.lit(BAD_LINE)).otherwise(fault)
    point = lambda s: F.transform(
        F.coalesce(s["values"], F.array().cast("array<array<string>>")),
        lambda v: F.struct(s["name"].alias("name"), s["tags"].alias("tags"), s["columns"].alias("columns"), v.alias("values")),
    )
    judged = told.select("value", error.alias("error"), series.alias("series"))
    rejected = F.col("error").isNotNull()
    entries = F.when(rejected, F.array(F.lit(None)).cast(_ENTRY)).otherwise(F.flatten(F.transform("series", point)).cast(_ENTRY))
    rows = judged.select(F.when(rejected, F.col("value")).alias("line"), "error", F.explode(entries).alias("entry"))
    kind = F.when(F.col("error").isNull(), POINT).otherwise(REJECTED)
    return rows.select(kind.alias("kind"), "entry.name", "entry.tags", "entry.columns", "entry.values", "line", "error")


def series_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None, allow_partial: bool = False
) -> DataFrame:
    """A folder that exported results are dropped into, one JSON object per line, as a stream of :func:`parse_lines`."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_lines(reader.text(path), allow_partial)


def store_series(stream: DataFrame, path: str, progress: str, every: str | None = None) -> StreamingQuery:
    """Append the stream to a table partitioned by ``kind``: points and rejected lines of a micro-batch commit together.

    A restart from the same ``progress`` folder goes on after the last committed
    micro-batch; nothing is written twice. Without ``every`` the files at hand are
    read and the query ends.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = stream.writeStream.format("parquet").outputMode("append").partitionBy("kind")
    return writer.option("checkpointLocation", progress).option("path", path).trigger(**trigger).start()


def stored_points(spark: SparkSession, path: str) -> DataFrame:
    """``name, tags, columns, values``, as the stored read of the results gives them."""
    return spark.read.schema(_ROW).parquet(path).where(F.col("kind") == POINT).select("name", "tags", "columns", "values")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(path).where(F.col("kind") == REJECTED).select("line", "error")
