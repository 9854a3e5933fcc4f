"""Declared schemas and the column positions of each feed.

Sources deliver rows as positional lists. The positions are used once, where a
row enters the engine; every later step addresses columns by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())

SERIES_RESULT = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "series",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("name", T.StringType()),
                                        T.StructField("tags", TAGS),
                                        T.StructField("columns", T.ArrayType(T.StringType())),
                                        T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
                                        T.StructField("partial", T.BooleanType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("error", T.StringType()),
                        T.StructField("partial", T.BooleanType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)

POINT = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("time", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Feed:
    """Where a feed keeps its key and values inside a positional row."""

    prefix: str
    time: int
    host: int
    metrics: tuple[int, ...]
    labels: tuple[int, ...] = ()
    #: Position of the tag that selects the feed's rows, and the pattern it must match.
    tag: int | None = None
    pattern: str = ""

    def metric_names(self) -> list[str]:
        return [f"{self.prefix}_{p}" for p in self.metrics]

    def label_names(self) -> list[str]:
        return [f"{self.prefix}_{p}" for p in self.labels]


# Positions of the columns each feed delivers.
CPU = Feed("cpu", time=0, host=3, metrics=(8, 13, 14), tag=1, pattern="cpu-total")
MEM = Feed("mem", time=0, host=8, metrics=(2, 7, 12))
NODE_MANAGER = Feed("nm", time=0, host=97, metrics=(39, 44, 51, 58), labels=(100,), tag=100, pattern="container.*$")
SPARK_DRIVER = Feed("spark", time=0, host=5, metrics=(8, 17, 27, 29, 52, 53, 54, 55, 56, 58, 59, 60, 61, 62))
JOB_VALUE, JOB_APP_ID = 0, 3
UNIFIED_LABEL = "nm_44"
TRAINING_SLICES = ((1, 5), (6, 9), (10, 11), (12, 13), (15, 16), (9, 10), (11, 12))
TRAINING_LABEL = 9
MISSING = -1


def string_columns(width: int) -> T.StructType:
    """All-string schema ``_c0 … _c{width-1}`` of a headerless file."""
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def labelled_columns(features: list[str], label: str) -> T.StructType:
    """Float features followed by an integer target."""
    return T.StructType(
        [T.StructField(f, T.FloatType()) for f in features] + [T.StructField(label, T.IntegerType())]
    )
