"""Host, container and job metrics on one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from metricweave.functions import ids
from metricweave.functions.numeric import int_label
from metricweave.operators.joins import KEY, join_jobs, join_metrics
from metricweave.operators.projection import fill_missing, flatten_unified
from metricweave.schemas import CPU, MEM, MISSING, NODE_MANAGER, UNIFIED_LABEL
from metricweave.sources.series import feed_rows

MEASUREMENTS = {"cpu": CPU, "mem": MEM, "nodemanager": NODE_MANAGER}
SOURCE = NODE_MANAGER.label_names()[0]
HOST_METRICS = [*CPU.metric_names(), *MEM.metric_names()]
CONTAINER_METRICS = [c for c in NODE_MANAGER.metric_names() if c != UNIFIED_LABEL]
FEATURES = [*HOST_METRICS, *CONTAINER_METRICS, "container_number", "app_number", "job_value"]


def container_rows(nm: DataFrame) -> DataFrame:
    """Container feed with a bare host name and the application each container belongs to."""
    return nm.withColumns(
        {"host": ids.strip_host_prefix(F.col("host")), "app_id": ids.app_id_from_container(F.col(SOURCE))}
    )


def unify(
    cpu: DataFrame, mem: DataFrame, nm: DataFrame, jobs: DataFrame, fill: int = MISSING, on: Sequence[str] = KEY
) -> DataFrame:
    """((cpu ⋈ mem) ⋈ nm on time and host) ⋈ jobs on application id.

    Feeds carry ``time``, ``host`` and their metrics, ``nm`` also the container
    source. The result is ``time``, the features and an integer ``label``; the
    host is dropped and the ids become numbers. The first two joins share their
    key, so one partitioning of the joined rows serves both.
    """
    return unify_containers(cpu, mem, container_rows(fill_missing(nm, fill, [SOURCE])), jobs, fill, on)


def unify_containers(
    cpu: DataFrame, mem: DataFrame, containers: DataFrame, jobs: DataFrame, fill: int = MISSING, on: Sequence[str] = KEY
) -> DataFrame:
    """:func:`unify` where the container feed already has its bare host and ``app_id``."""
    hosts = join_metrics(fill_missing(cpu, fill, CPU.metric_names()), fill_missing(mem, fill, MEM.metric_names()), on)
    metrics = fill_missing(containers, fill, NODE_MANAGER.metric_names())
    joined = join_jobs(join_metrics(hosts, metrics, on), jobs)
    return flatten_unified(joined).select(
        "time",
        *HOST_METRICS,
        *CONTAINER_METRICS,
        ids.container_id_number(F.col(SOURCE)).alias("container_number"),
        ids.app_id_number(F.col("app_id")).alias("app_number"),
        "job_value",
        int_label(F.col(UNIFIED_LABEL)).alias("label"),
    )


def unify_series(points: DataFrame, jobs: DataFrame) -> DataFrame:
    """The same from one frame of positional points, as :func:`read_series_json` gives them.

    All series of a measurement count as one feed, of which only the rows with
    the feed's tag take part: the totals of all cores, the containers. The frame
    is scanned once per feed, and each scan reads only its measurement where the
    table is partitioned by name.
    """
    cpu, mem, nm = (feed_rows(points, name, feed) for name, feed in MEASUREMENTS.items())
    return unify(cpu, mem, nm, jobs)
