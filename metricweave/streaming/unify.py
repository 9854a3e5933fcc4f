"""The unified table from live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.functions.times import floor_to
from metricweave.plans.unify import MEASUREMENTS, unify
from metricweave.schemas import MISSING
from metricweave.sources.series import feed_rows

# The event time stands beside the exact key, so that the watermark bounds the state of each join.
LIVE_KEY = ("time", "at", "host")


def marked(feed: DataFrame, delay: str, step: int | None = None) -> DataFrame:
    """A feed with its event time ``at`` and watermark; ``step`` cuts times to a grid of so many nanoseconds.

    Points without a time can meet nothing and are left out.
    """
    time = F.col("time") if step is None else floor_to(F.col("time"), step)
    rows = feed.where(F.col("time").isNotNull()).withColumn("time", time)
    micros = F.call_function("div", F.col("time"), F.lit(1000).cast("bigint"))
    return rows.withColumn("at", F.timestamp_micros(micros)).withWatermark("at", delay)


def unify_stream(
    cpu: DataFrame,
    mem: DataFrame,
    nm: DataFrame,
    jobs: DataFrame,
    delay: str = "0 seconds",
    step: int | None = None,
    fill: int = MISSING,
) -> DataFrame:
    """:func:`metricweave.plans.unify.unify` on streams; ``jobs`` is a table.

    A row waits for its partners until the watermark, the newest time of the slowest
    feed less ``delay``, has passed its own time; then its state is dropped. A row that
    comes later than that is left out, whatever it would have met: each stored row
    that the stream lacks has a partner that came after the watermark had passed their
    common time. Rows are emitted once, when the last of their partners comes.
    """
    feeds = (marked(feed, delay, step) for feed in (cpu, mem, nm))
    return unify(*feeds, jobs, fill, LIVE_KEY)


def unify_series_stream(
    points: DataFrame, jobs: DataFrame, delay: str = "0 seconds", step: int | None = None
) -> DataFrame:
    """The same from one stream of positional points, as :func:`series_stream` gives them."""
    cpu, mem, nm = (feed_rows(points, name, feed) for name, feed in MEASUREMENTS.items())
    return unify_stream(cpu, mem, nm, jobs, delay, step)
