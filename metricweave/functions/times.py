"""Epoch keys and timestamps.

Keys are 64-bit epoch nanoseconds. Spark timestamps hold microseconds, so a
timestamp is only ever derived from a key, never joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Nanoseconds per epoch unit.
UNIT_NS = {
    "ns": 1,
    "u": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
DAY_NS = 24 * UNIT_NS["h"]


def floor_to(epoch: Column, step: int) -> Column:
    """Start of the grid cell holding ``epoch``; integer arithmetic, also below zero."""
    return epoch - F.pmod(epoch, F.lit(step).cast("bigint"))


def _floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", floor_to(value, by), F.lit(by).cast("bigint"))


def epoch_to_timestamp(epoch: Column, unit: str = "ns") -> Column:
    scale = UNIT_NS[unit]
    if scale < 1000:
        return F.timestamp_micros(_floor_div(epoch, 1000 // scale))
    return F.timestamp_micros(epoch * F.lit(scale // 1000).cast("bigint"))


def timestamp_to_epoch(ts: Column, unit: str = "ns") -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    scale = UNIT_NS[unit]
    if scale < 1000:
        return micros * F.lit(1000 // scale).cast("bigint")
    return _floor_div(micros, scale // 1000)
