"""Appending columns to rows inside Python tasks, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from metricweave.llm.columns import quoted

#: A piece of a batch holds so many bytes of text, or one row.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text, so that a task's memory is bounded."""
    start, held = 0, 0
    for i, value in enumerate(batch.column(batch.schema.get_field_index(column))):
        size = len(value.as_buffer()) if value.is_valid else 0
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def append_columns(
    df: DataFrame, text: str, schema: str, work: Callable[[list[bytes]], list[list]]
) -> DataFrame:
    """Append the columns of ``schema``, computed by ``work`` from the UTF-8 texts.

    ``work`` takes a list of texts (null as empty) and returns a list of values
    per column. A column of ``df`` with one of the names, in any case, is replaced.
    """
    added = StructType.fromDDL(schema)
    taken = {f.name.lower() for f in added}
    kept = [c for c in df.columns if c.lower() not in taken]
    inner = df.select(*[quoted(c) for c in kept], F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary").alias("__text"))
    out = StructType([inner.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(out)
    kinds = [arrow.field(len(kept) + i).type for i in range(len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__text"):
                values = work(batch.column(len(kept)).to_pylist())
                made = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=arrow.names)

    return inner.mapInArrow(run, out)
