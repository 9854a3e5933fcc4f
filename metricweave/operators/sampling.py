"""Seeded permutation and the split into halves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from metricweave.operators.numbering import number_rows

TRAIN, TEST = "train", "test"
HEX_DIGITS, HASH_DIGITS = 3, 32
# the cut is read off a bucket of so few rows; a larger one is cut again, with the same answer
BUCKET_ROWS = 250_000


def shuffle_key(key: Sequence[str], seed: int) -> Column:
    """A hash of the row key and the seed; sorting by it permutes the rows.

    Different keys hash different texts: in a key of several columns each part
    carries its length, and a null its own mark.
    """
    parts = [F.col(k).cast("string") for k in key]
    if len(parts) == 1:
        marked = [F.coalesce(parts[0], F.lit("\x00"))]
    else:
        marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit("="), p), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", *marked, F.lit(str(seed))))


def shuffle_rows(
    df: DataFrame, key: Sequence[str], seed: int, name: str = "position", unique: bool = True
) -> DataFrame:
    """Append the row's place (from 1) in a permutation fixed by ``seed``.

    ``unique`` states that ``key`` identifies a row. Otherwise the permutation
    places rows by key and the rows of one key side by side.
    """
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    return number_rows(hashed, ["_hash"], name, unique).drop("_hash")


def half_cut(df: DataFrame, key: Sequence[str], seed: int, bucket_rows: int = BUCKET_ROWS) -> str | None:
    """The hash of the last row of the first half; None for fewer than two rows.

    Hash prefixes cut the rows into even buckets, in hash order. Counts per
    bucket, at most 16^HEX_DIGITS of them, find the one that holds the middle;
    it is cut again until one task may sort it, which takes one more round for
    a thousand times the rows.
    """
    hashed = df.select(shuffle_key(key, seed).alias("hash"))
    prefix, before, wanted, inside = "", 0, None, hashed
    while True:
        bucket = F.substring("hash", 1, len(prefix) + HEX_DIGITS)
        sizes = sorted(inside.groupBy(bucket.alias("bucket")).count().collect())
        if wanted is None:
            wanted = sum(rows for _, rows in sizes) // 2
            if wanted == 0:
                return None
        for prefix, rows in sizes:
            if before + rows >= wanted:
                break
            before += rows
        inside = hashed.where(F.col("hash").startswith(prefix))
        if rows <= bucket_rows or len(prefix) >= HASH_DIGITS:
            break
    return inside.orderBy("hash").limit(wanted - before).agg(F.max("hash").alias("cut")).first()["cut"]


def split_half(
    df: DataFrame, key: Sequence[str], seed: int, name: str = "half", unique: bool = True
) -> DataFrame:
    """First ⌊n/2⌋ rows of the permutation are ``train``, the rest ``test``.

    For a unique key the table is not shuffled: every row is compared with one
    hash, which is looked up beforehand.
    """
    if not unique:
        placed = shuffle_rows(df, key, seed, "_position", unique=False)
        return placed.withColumn(name, half_of(F.col("_position"), row_total(df))).drop("_position")
    cut = F.lit(half_cut(df, key, seed))
    return df.withColumn(name, F.when(shuffle_key(key, seed) <= cut, TRAIN).otherwise(TEST))


def class_cuts(
    df: DataFrame, key: Sequence[str], seed: int, by: str, bucket_rows: int = BUCKET_ROWS
) -> list[tuple[object, str | None]]:
    """The hash of the last row of each class's first half, as :func:`half_cut` finds it, for all classes at once.

    The driver sees counts per class and hash prefix, so ``by`` must have few values.
    """
    hashed = df.select(F.col(by).alias("class"), shuffle_key(key, seed).alias("hash"))
    digits, inside = HEX_DIGITS, hashed
    # class -> rows wanted from the open bucket on, prefix of that bucket
    left: dict[object, tuple[int, str]] = {}
    while True:
        sizes: dict[object, list[tuple[str, int]]] = {}
        for kind, prefix, rows in inside.groupBy("class", F.substring("hash", 1, digits).alias("prefix")).count().collect():
            sizes.setdefault(kind, []).append((prefix, rows))
        largest = 0
        for kind, buckets in sizes.items():
            wanted = left[kind][0] if kind in left else sum(rows for _, rows in buckets) // 2
            for prefix, rows in sorted(buckets):
                if rows >= wanted:
                    break
                wanted -= rows
            left[kind] = wanted, prefix
            largest = max(largest, rows)
        open_bucket = F.lit(False)
        for kind, (_, prefix) in left.items():
            open_bucket = open_bucket | (F.col("class").eqNullSafe(F.lit(kind)) & F.col("hash").startswith(prefix))
        inside = hashed.where(open_bucket)
        if largest <= bucket_rows or digits >= HASH_DIGITS:
            break
        digits += HEX_DIGITS
    # one bucket per class
    places = inside.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("hash")))
    last = F.lit(False)
    for kind, (wanted, _) in left.items():
        last = last | (F.col("class").eqNullSafe(F.lit(kind)) & (F.col("place") == wanted))
    cuts = dict(places.where(last).select("class", "hash").collect())
    return [(kind, cuts.get(kind)) for kind in left]


def split_half_by(df: DataFrame, key: Sequence[str], seed: int, by: str, name: str = "half") -> DataFrame:
    """The first ⌊n/2⌋ rows of every class in the permutation are ``train``, the rest ``test``.

    ``key`` identifies a row; null is a class like others. The table is not shuffled.
    """
    first = F.lit(False)
    for kind, cut in class_cuts(df, key, seed, by):
        if cut is not None:
            first = first | (F.col(by).eqNullSafe(F.lit(kind)) & (shuffle_key(key, seed) <= cut))
    return df.withColumn(name, F.when(first, TRAIN).otherwise(TEST))


def row_total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def half_of(position: Column, total: Column) -> Column:
    half = F.call_function("div", total, F.lit(2).cast("bigint"))
    return F.when(position <= half, TRAIN).otherwise(TEST)
