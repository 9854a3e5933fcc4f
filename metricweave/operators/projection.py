"""Positions, missing values, keys and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from metricweave.functions.numeric import int_label
from metricweave.schemas import MISSING
from metricweave.session import store


def positions(slices: Sequence[int | tuple[int, int]]) -> list[int]:
    """Half-open slices and single positions, in the order given."""
    out: list[int] = []
    for part in slices:
        out.extend([part] if isinstance(part, int) else range(*part))
    return out


def project_positions(
    df: DataFrame,
    slices: Sequence[int | tuple[int, int]],
    values: str = "values",
    names: Mapping[int, str] | None = None,
    prefix: str = "_c",
) -> DataFrame:
    """Columns picked from an array column by position; reordering is allowed.

    A position past the end of a short row gives null, so every row keeps the
    same width. Other columns of ``df`` are kept in front.
    """
    names = names or {}
    picked = [
        F.get(values, F.lit(p)).alias(names.get(p, f"{prefix}{p}")) for p in positions(slices)
    ]
    return df.select(*[c for c in df.columns if c != values], *picked)


def fill_missing(df: DataFrame, value: int = MISSING, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls become ``value``, in text columns its spelling."""
    wanted = set(df.columns if columns is None else columns)

    def filled(field: T.StructField) -> Column:
        fillable = isinstance(field.dataType, (T.NumericType, T.StringType))
        if field.name not in wanted or not fillable:
            return F.col(field.name)
        return F.coalesce(field.name, F.lit(value).cast(field.dataType)).alias(field.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def with_key(df: DataFrame, time: str, host: str) -> DataFrame:
    """Name the key columns ``time`` and ``host`` and put them in front."""
    rest = [c for c in df.columns if c not in (time, host)]
    return df.select(F.col(time).alias("time"), F.col(host).alias("host"), *rest)


def rekey(df: DataFrame, key: str) -> DataFrame:
    """Make ``key`` the leading column; the former key stays as a value."""
    return df.select(key, *[c for c in df.columns if c != key])


def flatten_unified(df: DataFrame) -> DataFrame:
    """Unified rows without the host: time, metrics, job value."""
    return df.drop("host")


def split_label(df: DataFrame, label: str, features: Sequence[str] | None = None) -> DataFrame:
    """Features and an integer ``label`` side by side on one row."""
    chosen = [c for c in df.columns if c != label] if features is None else list(features)
    return df.select(*chosen, int_label(F.col(label)).alias("label"))


def drop_last(df: DataFrame, order: Sequence[str], unique: bool = True) -> DataFrame:
    """All rows but the last one in ``order``.

    Where ``order`` identifies a row this is a filter against one scalar.
    Otherwise the rows are written down as they come, and of those tied for last
    the one written last is dropped.
    """
    if unique:
        last = df.agg(F.max(F.struct(*order))).scalar()
        return df.where(F.struct(*order) < last)
    placed = store(df, "rows").withColumn("_place", F.monotonically_increasing_id())
    last = placed.agg(F.max(F.struct(*order, "_place"))).scalar()
    return placed.where(F.struct(*order, "_place") < last).drop("_place")
