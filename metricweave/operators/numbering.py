"""Consecutive row numbers over a whole table without a single-task sort.

The table is range-partitioned and sorted by Spark, and each row's place inside
its partition is written with it to the shared folder. The partitions are then
fixed: counting them and reading them back see the same rows, also after an
executor is lost. A row's number is its place plus the rows of all partitions
before its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from metricweave.session import drop_scratch, store

# monotonically_increasing_id: partition number above 33 bits of place
PLACE_BITS = 33


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str = "row_number",
    unique: bool = True,
) -> DataFrame:
    """Append ``name`` = 1, 2, 3 … in ascending ``order``, nulls first.

    ``unique`` states that ``order`` identifies a row. Without that promise the
    rows are written down once as they come and their place in that table
    breaks the ties, so neither a hot key nor a mass of equal rows has to sit
    in one partition. Tables of every size take the same way: one range sort
    and one written table.
    """
    columns, keys, written = df.columns, list(order), None
    if not unique:
        written = store(df, "rows")
        df = written.withColumn("_tie", F.monotonically_increasing_id())
        keys.append("_tie")
    placed = store(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
            *columns, F.monotonically_increasing_id().alias("_place")
        ),
        "ordered",
    )
    if written is not None:
        drop_scratch(written)
    part = F.shiftright("_place", PLACE_BITS).cast("int").alias("_part")
    local = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    # one row per sort partition, whose number is a setting and not the data's
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.select(*columns, part, local.alias("_local"))
        .join(F.broadcast(offsets), "_part")
        .select(*columns, (F.col("_local") + F.col("_before")).alias(name))
    )
