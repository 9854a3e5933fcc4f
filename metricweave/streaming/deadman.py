"""Heartbeat check on a stream, silent intervals included."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metricweave.functions.times import floor_to
from metricweave.operators.alerts import ALIVE, DEAD, RUN, THRESHOLD

# Fixed value: default interval of the heartbeat rule.
INTERVAL = "10 seconds"

_STATE = "reported bigint, level string, slots array<bigint>, counts array<bigint>"


def emitted_stream(
    df: DataFrame, group: Sequence[str], ts: str, interval: str = INTERVAL, delay: str = "0 seconds"
) -> DataFrame:
    """Points per group and closed interval; a silent interval gives no row."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(*group, F.window(ts, interval))
        .agg(F.count(F.lit(1)).alias("emitted"))
        .select(*group, F.col("window.start").alias("slot"), "emitted")
    )


def deadman_stream(
    df: DataFrame,
    group: Sequence[str],
    ts: str,
    interval: str = INTERVAL,
    threshold: float = THRESHOLD,
    delay: str = "0 seconds",
    changes_only: bool = False,
) -> DataFrame:
    """The group columns, ``slot, emitted, level`` for each interval the watermark has closed.

    A group is known from its first point on, and a group that falls silent
    keeps reporting zero. ``changes_only`` reports a slot only when the level
    differs from the group's previous one.

    Points are first counted per (group, slot) inside each incoming Arrow
    batch, so what is shuffled to the group's task is a few counts per batch
    however many points one group sends. The state of a group is where its
    reports end, its last level and the counts of its open slots. A silence,
    however long, is one step of the group's function; its slots are made
    afterwards.
    """
    step = pd.Timedelta(interval) // pd.Timedelta("1us")
    group = list(group)
    keys = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    points = df.where(F.col(ts).isNotNull()).select(*group, floor_to(micros, step).alias("slot"), micros.alias("newest"))
    partial = (
        points.mapInPandas(_count_batches(group), f"{keys}, slot bigint, newest bigint, points bigint")
        .withColumn("newest", F.timestamp_micros("newest"))
        .withWatermark("newest", delay)
    )
    reported = partial.groupBy(*group).applyInPandasWithState(
        _close_slots(group, step, threshold, changes_only),
        f"{keys}, first bigint, last bigint, emitted bigint, level string",
        _STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    # a silence is one row up to here; it is cut into runs first, so that no array holds more than RUN slots
    width = F.lit(step).cast("bigint")
    runs = reported.withColumn("_from", F.explode(F.sequence("first", "last", width * RUN)))
    upto = F.least("last", F.col("_from") + width * (RUN - 1))
    slots = runs.withColumn("slot", F.explode(F.sequence("_from", upto, width)))
    return slots.select(*group, F.timestamp_micros("slot").alias("slot"), "emitted", "level")


def _count_batches(group: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby([*group, "slot"], as_index=False, dropna=False).agg(
                newest=("newest", "max"), points=("newest", "size")
            )

    return run


def _close_slots(group: list[str], step: int, threshold: float, changes_only: bool):
    names = [*group, "first", "last", "emitted", "level"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # reported: end of the last reported slot, null before the first report
        reported, level, slots, counts = state.get if state.exists else (None, None, [], [])
        waiting = dict(zip(slots, counts))
        for batch in batches:
            for slot, points in batch.groupby("slot")["points"].sum().items():
                if reported is None or slot >= reported:
                    waiting[int(slot)] = waiting.get(int(slot), 0) + int(points)
        if reported is None and not waiting:
            return

        slot = min(waiting) if reported is None else reported
        watermark = state.getCurrentWatermarkMs() * 1000
        closed, end = [], slot + max(0, (watermark - slot) // step) * step

        def close(first: int, last: int, emitted: int) -> None:
            nonlocal level
            now = DEAD if emitted <= threshold else ALIVE
            if not changes_only:
                closed.append((*key, first, last, emitted, now))
            elif now != level:
                closed.append((*key, first, first, emitted, now))
            level = now

        for at in sorted(s for s in waiting if s < end):
            if slot < at:
                close(slot, at - step, 0)
            close(at, at, waiting.pop(at))
            slot = reported = at + step
        if slot < end:
            close(slot, end - step, 0)
            slot = reported = end
        state.update((reported, level, list(waiting), list(waiting.values())))
        # fires once the watermark passes the end of the open slot
        state.setTimeoutTimestamp((slot + step) // 1000)
        if closed:
            yield pd.DataFrame(closed, columns=names)

    return run
