"""Removal of byte strings that occur elsewhere, by bucket refinement of sampled suffixes.

Every window of SPAN bytes has one anchor inside it, chosen by the window's
content alone (the smallest hash of a few bytes), so equal windows have equal
anchors at equal distance. Instead of all suffixes only those at anchors are
put into buckets, first by the bytes that follow them. A bucket is refined by
the identifiers of longer strings around the anchor, recursively: each level
halves no rank array but splits the range of distances between anchor and
window, and reuses the bucket identifier of the level above. Identifiers are
hashes chained over the levels, so that equal strings have equal identifiers
everywhere and no global sort is needed.

A bucket is only ever counted, with sums formed on the map side, so one string
that a third of all documents share is no single group in any task.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from metricweave.llm.arrow import pieces
from metricweave.llm.columns import quoted
from metricweave.session import drop_scratch, store

#: Length of the strings compared; bytes hashed to choose an anchor.
SPAN, GRAM = 200, 8
#: Window starts a task handles at once.
STARTS = 1 << 17
#: Bytes of text a task holds at once.
HELD = 1 << 20
#: Ways a range of distances splits at each level.
WAYS = 6


def reach(span: int) -> int:
    """The largest distance from a window's start to its anchor: three quarters of it."""
    return span - max(GRAM, span // 4)


def anchors(text: bytes, ends: np.ndarray, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``anchor, first, last``: runs of window starts with one anchor, STARTS window starts at a time.

    ``text`` is a run of documents that end at ``ends``; a window crosses no end.
    The anchor is the leftmost smallest gram of a window's first ``reach + 1`` places.
    """
    wide = reach(span) + 1
    for begin in range(0, max(0, len(text) - span + 1), STARTS):
        part = text[begin : begin + STARTS + span - 1]
        starts = len(part) - span + 1
        words = np.ndarray((len(part) - GRAM + 1,), dtype="<u8", buffer=part, strides=(1,))
        mixed = words * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(32)
        mixed <<= np.uint64(32)
        mixed |= np.arange(len(mixed), dtype=np.uint64)
        place = (_smallest(mixed, wide)[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64) + begin
        at = np.arange(begin, begin + starts)
        end = ends[np.searchsorted(ends, at, side="right")]
        place[at + span > end] = -1
        first = np.flatnonzero(np.diff(place, prepend=-2) != 0)
        last = np.append(first[1:], starts) - 1
        kept = place[first] >= 0
        yield place[first][kept], at[first][kept], at[last][kept]


def _smallest(values: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of every ``wide`` neighbours, from minima within blocks in both directions."""
    blocks = -(-len(values) // wide)
    padded = np.full((blocks, wide), ~np.uint64(0))
    padded.ravel()[: len(values)] = values
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - wide + 1], ahead[wide - 1 : len(values)])


#: ``run``: so many anchors, each one byte after the other, that agree in all identifiers and distances.
_ANCHORS = "text_id bigint, place bigint, root bigint, whole bigint, run bigint"


def _signed(text: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)


def _whole(text: bytes, at: int, low: int, high: int, span: int) -> int:
    """Identifier of all that an anchor's windows cover, and of the distances they stand at."""
    return _signed(text[at - high : at - low + span], low * span + high)


def _anchor_rows(span: int):
    """One row per anchor: its text, its place and distances, and two identifiers."""
    root = span - reach(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text", HELD)):
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            text = b"".join(texts)
            ids = batch.column(0).to_numpy()
            for place, first, last in anchors(text, ends, span):
                doc = np.searchsorted(ends, first, side="right")
                low, high = place - last, place - first
                roots = np.array([_signed(text[p : p + root]) for p in place.tolist()], dtype=np.int64)
                wholes = [_whole(text, *x, span) for x in zip(place.tolist(), low.tolist(), high.tolist())]
                wholes = np.array(wholes, dtype=np.int64)
                # a text of few letters has an anchor per byte, most of them alike
                new = np.ones(len(place), dtype=bool)
                new[1:] = np.diff(place) != 1
                for values in (doc, low, high, roots, wholes):
                    new[1:] |= values[1:] != values[:-1]
                begins = np.flatnonzero(new)
                runs = np.diff(np.append(begins, len(place)))
                packed = ((place - (ends - sizes)[doc]) << 32) | (low << 16) | high
                columns = [ids[doc][begins], packed[begins], roots[begins], wholes[begins], runs]
                made = [pa.array(np.asarray(c, dtype=np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(made, names=["text_id", "place", "root", "whole", "run"])

    return run


def _unpacked(place: int) -> tuple[int, int, int]:
    """Anchor, smallest and largest distance."""
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def _context_rows(span: int):
    """Texts with their open anchors to one row per context: the bytes that its windows cover.

    The identifier is formed again: a text that shares the other's id by chance is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text", HELD)):
            rows: list[tuple] = []
            for text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a in listed:
                    at, low, high = _unpacked(a["place"])
                    if _whole(text, at, low, high, span) == a["whole"]:
                        rows.append((a["root"], a["whole"], low, high, a["n"], text[at - high : at - low + span]))
            columns = list(zip(*rows)) or [()] * 6
            made = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["root", "whole", "low", "high", "n", "context"])

    return run


def _settle(df: DataFrame, *done: DataFrame) -> None:
    """After a written table: let go of shuffle files, and delete scratch tables no longer read."""
    for table in done:
        drop_scratch(table)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _refine(level: DataFrame, ranges: Sequence[tuple[int, int]], span: int) -> tuple[DataFrame, DataFrame]:
    """Split buckets by what surrounds the anchor: distances decided, and buckets still open.

    A row of ``level`` is a context with its open ``buckets``, each a range ``a``
    to ``b`` of distances in which the context occurs ``n`` times as far as known.
    Inside a narrower range all windows contain a common core, which names the
    refined bucket; a core without another occurrence holds no repeated window.
    Rows equal in all that their windows cover are the same string: if there are
    two, all these windows are repeated, and one row stays as a partner for the
    other rows of its bucket.
    """
    nodes = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in ranges])
    inside = lambda r: (r["a"] >= F.col("k.a")) & (r["b"] <= F.col("k.b")) & (r["a"] <= F.col("high")) & (r["b"] >= F.col("low"))
    cut = lambda begin, end: F.substring("context", (begin + 1).cast("int"), (end - begin).cast("int"))
    high, a, b, lo, hi = (F.col(c) for c in ("high", "r.a", "r.b", "lo", "hi"))
    split = level.select("root", "whole", "context", "low", "high", F.explode("buckets").alias("k"))
    split = split.select("*", F.explode(F.filter(nodes, inside)).alias("r"))
    split = split.select("*", F.greatest("low", "r.a").alias("lo"), F.least("high", "r.b").alias("hi"))
    split = split.withColumn("core", F.xxhash64("k.bucket", a, cut(high - a, high - b + span)))
    same = F.xxhash64("core", "lo", "hi", cut(high - hi, high - lo + span))
    split = store(split.select("root", "whole", "k.n", "r.a", "r.b", "lo", "hi", "core", same.alias("same")), "buckets")

    kinds = store(
        split.groupBy("core", "same").agg(
            F.sum("n").alias("n"), F.min(F.struct("root", "whole")).alias("owner"), F.min("a").alias("a"), F.min("b").alias("b")
        ),
        "buckets",
    )
    repeated = kinds.where("n > 1").select("core", "same")
    decided = split.where("n = 1").join(repeated, ["core", "same"]).select("root", "whole", "lo", "hi")
    undecided = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest"))
    undecided = undecided.where("kinds > 1 AND rarest = 1 ").select("core")
    # at most one entry per distance and context
    left = kinds.join(undecided, "core", "left_semi").groupBy("owner.root", "owner.whole").agg(
        F.collect_list(F.struct(F.col("core").alias("bucket"), "a", "b", "n")).alias("buckets")
    )
    decided = store(decided, "decided")
    following = store(level.drop("buckets").join(left, ["root", "whole"]), "open")
    _settle(following, split, kinds)
    return decided, following


def _levels(span: int) -> list[list[tuple[int, int]]]:
    """Ranges of distances per level, from WAYS of them down to single distances."""
    ranges, levels = [(0, reach(span))], []
    while any(a < b for a, b in ranges):
        ranges = [
            (a + (b - a + 1) * k // WAYS, a + (b - a + 1) * (k + 1) // WAYS - 1)
            for a, b in ranges for k in range(WAYS) if (b - a + 1) * (k + 1) // WAYS > (b - a + 1) * k // WAYS
        ]
        levels.append(ranges)
    return levels


def repeated_windows(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``text_id, found``: for each text with repeated windows, a list of
    ``struct<place, run, whole, lo, hi>``, at most one per run of anchors and level.

    ``texts`` has ``text_id, text`` (binary); equal texts have equal ids. Ids
    need not be free of collisions, since a reader forms ``whole`` again.
    """
    scan = lambda: texts.select("text_id", "text").mapInArrow(_anchor_rows(span), _ANCHORS)
    twice = store(scan().groupBy("root").agg(F.sum("run").alias("n")).where("n > 1").select("root"), "roots")
    _settle(twice)
    alive = store(scan().join(twice, "root", "left_semi"), "anchors")
    _settle(alive, twice)
    one = F.min(F.struct("text_id", "place")).alias("one")
    contexts = store(alive.groupBy("root", "whole").agg(F.sum("run").alias("n"), one), "contexts")
    several = contexts.groupBy("root").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest"))
    several = several.where("kinds > 1 AND rarest = 1").select("root")
    # a string that occurs once, next to others of its bucket, is open; one of each kind is its partner
    wanted = contexts.join(several, "root", "left_semi").select("one.text_id", F.struct("root", "whole", "one.place", "n").alias("a"))
    # at most the anchors of one text
    listed = store(wanted.groupBy("text_id").agg(F.collect_list("a").alias("listed")), "listed")
    opened = texts.join(listed, "text_id").select("text", "listed").mapInArrow(
        _context_rows(span), "root bigint, whole bigint, low bigint, high bigint, n bigint, context binary"
    )
    # equal texts give equal rows
    level = store(opened.dropDuplicates(["root", "whole"]), "open")
    _settle(level, listed)
    all_distances = F.struct(F.col("root").alias("bucket"), F.lit(0).cast("bigint").alias("a"), F.lit(reach(span)).cast("bigint").alias("b"), "n")
    level = level.select("root", "whole", "low", "high", "context", F.array(all_distances).alias("buckets"))
    unset = F.lit(None).cast("bigint")
    ranges = contexts.where("n > 1").select("root", "whole", unset.alias("lo"), unset.alias("hi"))
    for nodes in _levels(span):
        before = level
        decided, level = _refine(level, nodes, span)
        _settle(level, before)
        ranges = ranges.unionByName(decided)
    found = alive.join(ranges, ["root", "whole"]).select("text_id", F.struct("place", "run", "whole", "lo", "hi").alias("f")).distinct()
    return store(found.groupBy("text_id").agg(F.collect_list("f").alias("found")), "repeats")


def remove_repeats(df: DataFrame, text: str = "text", span: int = SPAN, keep_bytes: bool = False) -> DataFrame:
    """Append ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (binary).

    Removed is every byte inside a string of ``span`` bytes that also starts
    anywhere else, in the same text or another; all are judged on the input.
    Texts are compared as UTF-8 bytes and matches never cross texts. A null text
    is empty; a repeated row makes all its strings repeated; texts shorter than
    ``span`` lose nothing. Rows are neither dropped nor merged, an empty table
    gives an empty table, clashing input columns are replaced.
    """
    value = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = df.withColumn("__id", F.xxhash64(value)).withColumn("__text", value.cast("binary"))
    windows = repeated_windows(rows.select(F.col("__id").alias("text_id"), F.col("__text").alias("text")), span)
    _settle(windows)
    added = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", "string")]
    names = [n for n, _ in added] + ["kept"] * keep_bytes
    kept = [c for c in df.columns if c.lower() not in names]
    wanted = rows.join(windows, F.col("__id") == F.col("text_id"), "left").select(*map(quoted, kept), "__text", "found")
    out = StructType([wanted.schema[c] for c in kept])
    for name, kind in added:
        out = out.add(name, kind)
    if keep_bytes:
        out = out.add(StructField("kept", BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "__text", HELD)):
            given = zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())
            columns = list(zip(*[_removed(*x, span) for x in given])) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[f.name for f in out])

    return wanted.mapInArrow(run, out)


def _removed(text: bytes, found: list[dict] | None, span: int) -> tuple[int, int, int, str, bytes]:
    """Length, bytes and runs removed, digest and bytes of what stays."""
    ranges = []
    for f in found or ():
        at, low, high = _unpacked(f["place"])
        if _whole(text, at, low, high, span) == f["whole"]:
            ranges.append((at - (high if f["hi"] is None else f["hi"]), at - (low if f["lo"] is None else f["lo"]) + span + f["run"] - 1))
    parts, at, runs = [], 0, 0
    for a, b in sorted(ranges):
        if a > at or not runs:
            parts.append(text[at:a])
            runs += 1
        at = max(at, b)
    rest = b"".join([*parts, text[at:]])
    return len(text), len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest
