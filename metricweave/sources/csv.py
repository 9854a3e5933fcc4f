"""Comma-separated rows, with and without header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from metricweave.schemas import labelled_columns, string_columns

# A quote inside quotes is doubled. A row of another width or a cell of another type
# stops the read; seeing widths takes all columns.
STRICT = {"escape": '"', "mode": "FAILFAST", "columnPruning": "false"}


def read_rows_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Headerless file of ``width`` text columns ``_c0, _c1, …``; rows of another width are an error."""
    return spark.read.options(**STRICT).schema(string_columns(width)).csv(path, header=False)


def read_labelled_csv(
    spark: SparkSession, path: str, features: list[str], label: str, schema: T.StructType | None = None
) -> DataFrame:
    """Headed file of float features and an integer target; a cell that is no number is an error."""
    return spark.read.options(**STRICT).schema(schema or labelled_columns(features, label)).csv(path, header=True)


def write_rows_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """Write every column, the label included, so a re-read sees the same positions."""
    df.write.mode("errorifexists").csv(path, header=header, escape='"')
