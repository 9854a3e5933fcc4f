"""Bucket-pointer refinement of all suffixes, as joins and groups.

Suffixes are put into buckets by their first bytes. A round refines every bucket by
the bucket identifier that the suffix a fixed offset later has, and reuses the
refined identifiers in the next round, so the compared length doubles each time;
buckets of one suffix are finished and leave. Identifiers are places, the smallest of
a bucket, so equal identifiers mean equal bytes with no hash between.

Every byte of the input is a row here, which costs a multiple of the input in each
round: ``repeats.py`` does the same work on sampled suffixes. This form stands beside
it to measure and to check that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricweave.llm.arrow import pieces
from metricweave.session import store

#: Bytes that name the first buckets.
GRAM = 8


def first_buckets(texts: DataFrame) -> DataFrame:
    """``text_id, at, bucket``: every suffix of GRAM bytes or more, from ``text_id, text`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text", 1 << 20)):
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) >= GRAM:
                    grams = np.ndarray((len(text) - GRAM + 1,), dtype="<i8", buffer=text, strides=(1,)).copy()
                    columns = [pa.array(np.full(len(grams), text_id)), pa.array(np.arange(len(grams))), pa.array(grams)]
                    yield pa.RecordBatch.from_arrays(columns, names=["text_id", "at", "bucket"])

    return texts.select("text_id", "text").mapInArrow(run, "text_id bigint, at bigint, bucket bigint")


def repeated_starts(texts: DataFrame, span: int) -> DataFrame:
    """``text_id, at``: where a string of ``span`` bytes begins that begins elsewhere too.

    ``text_id`` identifies a row of ``texts``; ``span`` is at least GRAM.
    """
    level = first_buckets(texts)
    several = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    first = F.struct("bucket", F.lit(None).cast("bigint").alias("rest")).alias("bucket")
    level = store(level.join(several, "bucket").select("text_id", "at", first), "refined")
    known = GRAM
    while known < span:
        step = min(known, span - known)
        later = level.select("text_id", (F.col("at") - step).alias("at"), F.col("bucket").alias("later"))
        paired = level.join(later, ["text_id", "at"])
        least = F.min(F.struct("text_id", "at"))
        named = paired.groupBy("bucket", "later").agg(F.count(F.lit(1)).alias("n"), least.alias("named")).where("n > 1")
        renamed = F.struct(F.col("named.text_id").alias("bucket"), F.col("named.at").alias("rest")).alias("bucket")
        level = store(paired.join(named, ["bucket", "later"]).select("text_id", "at", renamed), "refined")
        known += step
    return level.select("text_id", "at")
