"""Dotted metric names such as ``nodemanager.jvm.Context=jvm.Hostname=n1.MemHeapUsedM``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# a Key=value segment with its closing dot, so never the last segment
PAIR = r"([^.=]+)=([^.]*)\."


def metric_path(name: Column) -> Column:
    """Struct ``(prefix, tags, leaf)`` of a dotted metric name.

    ``tags`` maps the ``Key=value`` segments, the first of a repeated key
    winning; ``leaf`` is the last segment; ``prefix`` joins the plain segments
    before it.
    """
    keys, values = (F.regexp_extract_all(name, F.lit(PAIR), F.lit(group)) for group in (1, 2))
    plain = F.regexp_replace(name, PAIR, "")
    # a map takes each key once; names that repeat one are rare and go the longer way
    first_only = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")),
                          lambda pair, i: F.array_position(keys, pair["key"]) == i + 1)
    distinct = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.struct(
        F.regexp_replace(plain, r"\.?[^.]*$", "").alias("prefix"),
        F.when(distinct, F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(first_only)).alias("tags"),
        F.substring_index(name, ".", -1).alias("leaf"),
    )
