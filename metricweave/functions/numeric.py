"""Activations, limits and label casts. Null input stays null throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Allocation limits of the cluster (megabytes, virtual cores).
MEMORY_MB = (128, 2500)
VCORES = (1, 4)


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    # greatest/least skip nulls, which would turn a missing value into a limit
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low).cast("double")).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high).cast("double")).otherwise(out)
    return out


def relu(value: Column) -> Column:
    return clamp(value, low=0.0)


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def clamp_allocation(
    memory_mb: Column,
    vcores: Column,
    memory_limits: tuple[int, int] = MEMORY_MB,
    vcore_limits: tuple[int, int] = VCORES,
) -> Column:
    """Struct ``(memory_mb, vcores)`` a scheduler would grant for a request."""
    return F.struct(
        clamp(memory_mb, *memory_limits).alias("memory_mb"),
        clamp(vcores, *vcore_limits).alias("vcores"),
    )


def int_label(value: Column) -> Column:
    """Truncate toward zero; dirty text gives null instead of failing the job."""
    return value.try_cast("double").try_cast("int")
