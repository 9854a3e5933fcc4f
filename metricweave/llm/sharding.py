"""Shards of a shuffled table: a two-pass external shuffle.

The first pass scatters the records over memory-sized buckets by a seeded hash;
bucket and shuffle partition are one and the same, so a bucket is the work of one
task. The second pass sorts each bucket by that hash, which makes its order the same
however the records arrived, permutes it by Fisher-Yates (Spark's ``shuffle``, whose
generator starts from the seed plus the partition's number) and writes it. The
written buckets, one after the other, are the permuted table; it is cut into equal
shards by the counts of the buckets before. Both passes are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from metricweave.llm.columns import quoted, whole
from metricweave.session import store

#: A bucket holds so many bytes on average; a task holds a small multiple of that.
BUCKET_BYTES = 32 << 20
#: Added to a record's text for its other columns.
ROW_BYTES = 64


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.octet_length(whole(text)).cast("bigint") + 1


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; a null text has none, hence 0."""
    return F.crc32(whole(text).cast("binary"))


def scatter_hash(df: DataFrame, seed: int) -> Column:
    """A seeded hash of the whole record and of the task that reads it.

    Without the task's number a mass of equal records would share one bucket. A task
    that runs again reads the same records, so they get the same hashes; the place
    of a record within its task plays no part.
    """
    hashed = [quoted(f.name) for f in df.schema if not _holds_map(f.dataType)]
    return F.xxhash64(F.lit(seed), F.spark_partition_id(), *hashed)


def _holds_map(kind: T.DataType) -> bool:
    """Maps and variants have no hash."""
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def shuffle_buckets(df: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``bucket, place, record``: every bucket scattered by hash, permuted and written."""
    record = F.struct(*[quoted(c) for c in df.columns]).alias("record")
    drawn = df.select(scatter_hash(df, seed).alias("drawn"), record)
    # the low bits choose the bucket, the whole hash orders it
    scattered = drawn.withColumn("bucket", F.pmod("drawn", F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
    gathered = scattered.sortWithinPartitions("drawn").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    permuted = gathered.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    return store(permuted.select("bucket", F.posexplode("records").alias("place", "record")), "buckets")


def shuffle_into_shards(
    df: DataFrame, shards: int, seed: int = 0, text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Append ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless) of the shuffled table.

    Row counts of the shards differ by one at most, whatever the texts' sizes. Rows
    are neither dropped nor repeated: null ids and texts are values like others, equal
    rows are separate records, an empty table gives no rows. Input columns named
    ``shard`` or ``slot``, in any case, are replaced; others keep name and value. The
    same rows, read by the same tasks, get the same places under the same seed. A
    bucket holds ``bucket_bytes`` on average, or one record larger than that.

    Sizing the buckets runs one job and writing them another, while the query is
    being defined.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    total = df.agg(F.sum(record_size(quoted(text)) + F.lit(ROW_BYTES))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    placed = shuffle_buckets(df.select(*[quoted(c) for c in kept]), buckets, seed)
    # one row per bucket, whose number is the table's bytes over the bucket's
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy("bucket")
    offsets = sizes.select(
        "bucket",
        (F.sum("rows").over(order) - F.col("rows")).alias("before"),
        F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    joined = placed.join(F.broadcast(offsets), "bucket")
    at, total, count = F.col("before") + F.col("place"), F.col("total"), F.lit(shards).cast("bigint")
    shard = F.call_function("div", (at + 1) * count - 1, total)
    slot = at - F.call_function("div", shard * total, count)
    return joined.select(
        *[F.col("record").getField(c).alias(c) for c in kept], shard.cast("int").alias("shard"), slot.alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, every file holding its slots in order."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
