"""SimHash near-duplicates, compared bit-sliced.

Texts become 64-bit fingerprints in one pass. Distinct fingerprints are dealt
into buckets that any two within the radius share: the 64 bits form
``radius + 2`` blocks, differing bits spoil at most ``radius`` of them, so two
blocks agree. Inside a bucket fingerprints are stored as bit planes: plane ``k``
holds bit ``k`` of 64 fingerprints in one word. One query is compared with a
whole plane at a time; vertical carry-save counters add the differing bits for
all lanes at once, and a block is abandoned as soon as every lane has exceeded
the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from metricweave.llm.arrow import append_columns
from metricweave.llm.columns import quoted, with_columns
from metricweave.llm.components import components
from metricweave.session import store

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
#: Lanes compared at once; a bucket of more is dealt into tiles of so many.
LANES = 1024
#: A bucket of more distinct fingerprints than this is refined, then tiled.
BUCKET = 8 * LANES
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the hashes of all word shingles."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    width = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), COUNTED):
        spans = zip(starts[at : at + COUNTED], ends[width - 1 + at : width - 1 + at + COUNTED])
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "simhash") -> DataFrame:
    """Append the fingerprint as a signed bigint; a text without words has 0."""
    return append_columns(df, text, f"`{name}` bigint", lambda texts: [[fingerprint(t, shingle) for t in texts]])


def planes(lanes: np.ndarray) -> np.ndarray:
    """Fingerprints (a multiple of 64) as bit planes: ``[bit, word]``, a lane per bit of a word."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_lanes(queries: np.ndarray, stored: np.ndarray, open_lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each query, a bit per lane: set where the distance is at most ``radius``.

    ``open_lanes`` says which lanes count at all. Counters are vertical: bit j of
    every lane's distance lies in ``counter[j]``; adding a plane of differences
    ripples a carry upwards, and what leaves the top, or reaches radius + 1,
    marks the lane as exceeded for good.
    """
    top = max(1, (radius + 1).bit_length())
    counter = [np.zeros_like(open_lanes) for _ in range(top)]
    exceeded = ~open_lanes
    for bit in range(BITS):
        ask = np.where((queries >> np.uint64(bit)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        carry = (stored[bit][None, :] ^ ask[:, None]) & ~exceeded
        for j in range(top):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        exceeded |= carry
        reached = ~np.uint64(0)
        for j in range(top):
            reached = reached & (counter[j] if (radius + 1) >> j & 1 else ~counter[j])
        exceeded |= reached
        if bit % 4 == 3 and np.all(exceeded == ~np.uint64(0)):
            break
    return ~exceeded


def _links(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between values of one group, in blocks of LANES; ``groups`` is sorted."""
    start = 0
    while start < len(values):
        stop = min(start + LANES, len(values))
        if stop < len(values) and groups[stop] == groups[stop - 1]:
            first = int(np.searchsorted(groups, groups[stop]))
            if first > start:
                stop = first  # whole groups only, if they fit
            else:
                stop = int(np.searchsorted(groups, groups[start], side="right"))
        for a in range(start, stop, LANES):
            for b in range(a, stop, LANES):
                yield from _tile(values, groups, a, min(a + LANES, stop), b, min(b + LANES, stop), radius)
        start = stop


def _tile(values, groups, a, a_end, b, b_end, radius):
    lanes = np.zeros(-(-(b_end - b) // 64) * 64, dtype="<u8")
    lanes[: b_end - b] = values[b:b_end]
    same = np.zeros((a_end - a, len(lanes)), dtype=bool)
    same[:, : b_end - b] = groups[a:a_end, None] == groups[None, b:b_end]
    if a == b:
        same &= np.arange(len(lanes))[None, :] > np.arange(a_end - a)[:, None]
    open_lanes = np.packbits(same, axis=1, bitorder="little").view("<u8")
    found = near_lanes(values[a:a_end], planes(lanes), open_lanes, radius)
    rows, words = np.nonzero(found)
    if len(rows):
        bits = np.unpackbits(found[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(bits)
        yield values[a + rows[hit]], values[b + words[hit] * 64 + lane]


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(ends[: len(x)].tolist(), ends[len(x) :].tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    up = np.array([root(i) for i in range(len(nodes))])
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[child], nodes[up[child]]


#: Fingerprints a task compares before it writes links out.
HELD = 64 * LANES


def _compare(radius: int):
    """Sorted ``key, fp`` batches to links; a bucket that spans batches stays together."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, "<i8"), np.empty(0, "<u8")
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view("<u8")])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut >= HELD:
                yield from _out(keys[:cut], values[:cut], radius)
                keys, values = keys[cut:], values[cut:]
        yield from _out(keys, values, radius)

    return links


def _out(keys: np.ndarray, values: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    _, at, size = np.unique(keys, return_inverse=True, return_counts=True)
    shared = size[at] > 1
    for x, y in _links(values[shared], at[shared], radius):
        a, b = _forest(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])


def _blocks(low: int, high: int, count: int) -> list[tuple[int, int]]:
    """Bits ``low`` to ``high`` in ``count`` runs of nearly equal width: ``(first, width)``."""
    edges = [low + (high - low) * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _tables(fp: Column, radius: int) -> Column:
    """One key per pair of blocks that may agree."""
    blocks = _blocks(0, BITS, radius + 2)
    pairs = combinations(blocks, 2)
    return F.array(*[F.xxhash64(F.lit(k), _bits(fp, *a), _bits(fp, *b)) for k, (a, b) in enumerate(pairs)])


def _narrower(fp: Column, radius: int) -> Column:
    """Further keys below a bucket: of ``radius + 1`` interleaved bit sets one agrees."""
    sets = []
    for k in range(radius + 1):
        mask = sum(1 << bit for bit in range(k, BITS, radius + 1))
        sets.append(F.struct(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*[F.xxhash64(s) for s in sets])


def near_links(prints: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs within ``radius`` bits.

    ``prints`` holds distinct fingerprints. Nothing is capped: a bucket of more
    than BUCKET fingerprints is refined by further bits that must agree, and
    what is still larger is compared in tiles of BUCKET, each pair of tiles in
    a group of its own.
    """
    value = quoted(fp)
    keyed = store(prints.select(F.explode(_tables(value, radius)).alias("key"), value.alias("fp")), "buckets")
    small, large = _by_size(keyed)
    if large is not None:
        narrow = large.select(F.explode(F.transform(_narrower(F.col("fp"), radius), lambda s: F.xxhash64("key", s))).alias("key"), "fp")
        fitting, still = _by_size(store(narrow.distinct(), "buckets"))
        small = small.unionByName(fitting)
        if still is not None:
            small = small.unionByName(_tiles(still))
    dealt = small.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_compare(radius), "a bigint, b bigint").distinct()


def _by_size(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of buckets up to BUCKET, and those of larger ones with their bucket's size."""
    big = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    big = store(big, "sizes")
    if big.isEmpty():
        return keyed, None
    return keyed.join(big, "key", "left_anti"), keyed.join(big, "key")


def _tiles(large: DataFrame) -> DataFrame:
    """Each fingerprint once per pair of tiles that its own tile is in."""
    tiles = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    cut = large.select("key", "fp", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"), own.alias("own"))
    return cut.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    keep_text: bool = True,
) -> DataFrame:
    """Append ``simhash`` (bigint), ``component_id`` (the smallest id reachable) and ``chosen``.

    Fingerprints at ``radius`` or fewer differing bits are linked, equal ones
    included, so all texts without words form one class with whatever lies near
    zero. Exactly one row of every class is chosen: one with the smallest id,
    the first read of them. A null text is empty; a null id is the smallest only
    where its whole class has none. Repeated rows stay, an empty table gives an
    empty table, clashing input columns are replaced. Without ``keep_text`` the
    text is left out, and not written to the shared folder with the fingerprints.
    """
    printed = with_fingerprints(df, text, shingle).withColumn("_row", F.monotonically_increasing_id())
    printed = store(printed if keep_text else printed.drop(text), "fingerprints")
    first = F.struct(quoted(id).isNull(), quoted(id).alias("id"), F.col("_row").alias("row"))
    prints = store(printed.groupBy("simhash").agg(F.min(first).alias("_least")), "prints")
    nodes = components(near_links(prints, "simhash", radius))
    roots = prints.join(nodes, F.col("simhash") == F.col("node"), "left")
    roots = roots.select(F.col("simhash").alias("_fp"), "_least", F.coalesce("root", "simhash").alias("_root"))
    least = roots.groupBy("_root").agg(F.min("_least").alias("_first"))
    of_print = roots.join(least, "_root").select("_fp", "_first")
    joined = printed.join(of_print, F.col("simhash") == F.col("_fp"))
    columns = {"component_id": F.col("_first.id"), "chosen": F.col("_first.row") == F.col("_row")}
    return with_columns(joined, columns).drop("_fp", "_first", "_row")
