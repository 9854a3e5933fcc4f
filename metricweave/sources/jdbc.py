"""Relational job history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from metricweave.schemas import JOB_APP_ID, JOB_VALUE


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    **properties: str,
) -> dict[str, str]:
    """Reader options; a partition column with bounds splits the scan into range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"} | properties
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partitioned scan needs the bounds of its partition column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, predicates: Sequence[str] | None = None, one_task: bool = False, **options
) -> DataFrame:
    """Scan a table; filters and column pruning are pushed into the database.

    ``predicates`` gives one scan task per condition, for keys that are not
    numeric, such as application ids. A scan that is not split reads the whole
    table in one task, so it must be asked for by ``one_task``.
    """
    if predicates is None and not one_task and "partition_column" not in options:
        raise ValueError("name a partition_column or predicates, or ask for one_task")
    settings = jdbc_options(url, table, **options)
    if predicates is None:
        return spark.read.format("jdbc").options(**settings).load()
    target, name = settings.pop("url"), settings.pop("dbtable")
    return spark.read.jdbc(target, name, predicates=list(predicates), properties=settings)


def job_history(rows: DataFrame) -> DataFrame:
    """Positional job rows → ``app_id, job_value``."""
    names = rows.columns
    return rows.select(
        rows[names[JOB_APP_ID]].alias("app_id"),
        rows[names[JOB_VALUE]].alias("job_value"),
    )
