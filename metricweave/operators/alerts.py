"""Heartbeat checks on stored points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricweave.functions.times import floor_to
from metricweave.operators.numbering import PLACE_BITS
from metricweave.session import store

# Defaults of the heartbeat rule (nanoseconds, points).
INTERVAL = 10_000_000_000
THRESHOLD = 0.0
ALIVE, DEAD = "OK", "CRITICAL"
# slots of a silence that are made at once
RUN = 8640
# Texts of the heartbeat rule.
ID_TEXT = "%s:NODE_NAME for task '%s'"
MESSAGE_TEXT = "%s is %s: %.3f points/INTERVAL."


def level_of(emitted: Column, threshold: float = THRESHOLD) -> Column:
    """Dead when an interval emitted at most ``threshold`` points."""
    return F.when(emitted <= threshold, DEAD).otherwise(ALIVE)


def deadman(
    df: DataFrame,
    group: Sequence[str],
    time: str = "time",
    interval: int = INTERVAL,
    threshold: float = THRESHOLD,
    start: Column | None = None,
    stop: Column | None = None,
) -> DataFrame:
    """Points per group and interval, silent intervals included: ``group, slot, emitted, level``.

    ``start`` and ``stop`` are the first and last slot; by default those of the
    whole table. A group that is silent all through is reported as well. Points
    without a time count nowhere.

    Points are counted per (group, slot) before anything else, and silence is
    filled in from the gap to the group's next slot, so the grid of groups and
    slots is produced in place and never joined.
    """
    counted = df.where(F.col(time).isNotNull()).groupBy(*group, floor_to(F.col(time), interval).alias("slot")).agg(
        F.count(F.lit(1)).alias("emitted")
    )
    first = counted.agg(F.min("slot")).scalar() if start is None else start
    last = counted.agg(F.max("slot")).scalar() if stop is None else stop

    step = F.lit(interval).cast("bigint")
    along = Window.partitionBy(*group).orderBy("slot")
    # A row covers the silence up to the group's next row, the first row also
    # that before it; points outside the range still make their group known.
    begin = F.when(F.lag("slot").over(along).isNull(), first).otherwise(F.col("slot"))
    end = F.coalesce(F.lead("slot").over(along) - step, last)
    stretches = counted.select(
        *group, "slot", "emitted", F.greatest(begin, first).alias("_begin"), F.least(end, last).alias("_end")
    ).where(F.col("_begin") <= F.col("_end"))
    # A long silence is cut into runs first, so that no array holds more than RUN slots of it.
    runs = stretches.select(
        *group, "slot", "emitted", "_end", F.explode_outer(F.sequence("_begin", "_end", step * RUN)).alias("_from")
    )
    upto = F.least("_end", F.col("_from") + step * (RUN - 1))
    slots = runs.select(*group, "slot", "emitted", F.explode_outer(F.sequence("_from", upto, step)).alias("_slot"))
    emitted = F.when(F.col("_slot") == F.col("slot"), F.col("emitted")).otherwise(0)
    return slots.select(
        *group, F.col("_slot").alias("slot"), emitted.alias("emitted"), level_of(emitted, threshold).alias("level")
    )


def with_message(df: DataFrame, group: Sequence[str], task: str) -> DataFrame:
    """Add the alert's ``id`` and ``message``; a group reads ``tag=value,tag=value``."""
    tags = F.concat_ws(",", *[F.concat(F.lit(f"{g}="), F.col(g).cast("string")) for g in group])
    state = F.when(F.col("level") == ALIVE, "alive").otherwise("dead")
    named = df.withColumn("id", F.format_string(ID_TEXT, tags, F.lit(task)))
    return named.withColumn("message", F.format_string(MESSAGE_TEXT, "id", state, F.col("emitted").cast("double")))


def state_changes_only(df: DataFrame, group: Sequence[str], order: Sequence[str], level: str = "level") -> DataFrame:
    """Rows whose level differs from the group's previous one; the first row counts as a change.

    ``order`` tells the rows of a group apart. The table is range-partitioned by
    group and order and written once, so a group of any size lies in as many
    pieces as it needs; each piece is compared by itself and opened by a row
    that carries the last level of the group's piece before.
    """
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    pieces = store(ordered.withColumn("_place", F.monotonically_increasing_id()), "levels")
    piece = F.shiftright("_place", PLACE_BITS)
    pieces = pieces.withColumns({"_piece": piece, "_opening": F.lit(False)})
    last = F.max(F.struct("_place", F.col(level).alias("_level")))["_level"].alias("_level")
    # one row per group and sort partition
    closing = pieces.groupBy(*group, "_piece").agg(last)
    earlier = F.lag(F.struct("_level")).over(Window.partitionBy(*group).orderBy("_piece"))
    opening = (
        closing.select(*group, "_piece", earlier.alias("_earlier"))
        .where(F.col("_earlier").isNotNull())
        .select(*group, "_piece", F.col("_earlier._level").alias(level), F.lit(True).alias("_opening"))
    )
    pieces = pieces.unionByName(opening, allowMissingColumns=True)
    along = Window.partitionBy(*group, "_piece").orderBy(F.col("_opening").desc(), "_place")
    before = F.lag(F.struct(level)).over(along)
    # no previous row is null; a previous null level is a struct holding null
    differs = F.col("_before").isNull() | ~F.col("_before")[level].eqNullSafe(F.col(level))
    return pieces.withColumn("_before", before).where(~F.col("_opening") & differs).select(*df.columns)
