"""Benchmark decontamination by Wu-Manber search over words.

A window is a run of consecutive words of a benchmark item. The search moves a
window-sized frame over a document's words: a shift table, keyed by the last
block of words in the frame, tells how far it may jump; where the shift is
zero, the bucket of that suffix and first word names the windows that may end
here, and comparing the words decides.

Documents are not shuffled. The benchmark is the stated query set: it is cut
into shards of a bounded number of windows, each of which is broadcast and
searched for in all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from metricweave.llm.arrow import append_columns
from metricweave.llm.columns import quoted, with_columns
from metricweave.session import store

WINDOW = 10
#: Windows searched for at once, and windows of an item that stay together.
SHARD_WINDOWS, SEGMENT_WINDOWS = 100_000, 10_000
BLOCK = 2

# A-Z in lower case, and every ASCII character that is no letter or digit a space
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def fold_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and any non-ASCII characters."""
    return text.translate(_FOLD).split()


class WuManber:
    """Occurrences of word windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for words, owners in windows.items():
            for last in range(self.block - 1, length):
                block = words[last - self.block + 1 : last + 1]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - 1 - last)
            bucket = self.buckets.setdefault(words[length - self.block :], {})
            bucket.setdefault(words[0], []).append((list(words), owners))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """``(start, owners)`` of every occurrence, in text order."""
        shift, furthest, back = self.shift.get, self.furthest, self.length - 1
        last, end, two = back, len(words), self.block == 2
        while last < end:
            block = (words[last - 1], words[last]) if two else (words[last],)
            jump = shift(block, furthest)
            if jump:
                last += jump
                continue
            start = last - back
            for window, owners in self.buckets[block].get(words[start], ()):
                if words[start : last + 1] == window:
                    yield start, owners
            last += 1


class Searcher:
    """All windows of a set of item segments: one table per window length."""

    def __init__(self, segments: Iterable[tuple[str | None, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        self.names: list[str | None] = []
        known: dict[str | None, int] = {}
        for name, text in segments:
            words = text.split()
            if not words:
                continue
            owner = known.setdefault(name, len(known))
            length = min(window, len(words))
            windows = by_length.setdefault(length, {})
            for i in range(len(words) - length + 1):
                windows.setdefault(tuple(words[i : i + length]), set()).add(owner)
        self.names = list(known)
        self.tables = [WuManber(windows, length) for length, windows in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans of hit words (end exclusive), and the names of the items found."""
        hits, owners = [], set()
        for table in self.tables:
            for start, own in table.search(words):
                hits.append((start, start + table.length))
                owners |= own
        names = sorted({self.names[o] for o in owners} - {None})
        return merged(hits), names


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for start, end in sorted(hits):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


# one searcher per Python worker and shard, kept while the worker lives
_BUILT: dict[str, Searcher] = {}


def _searcher(key: str, segments, window: int) -> Searcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searcher(segments.value, window)
    return _BUILT[key]


def _segments(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``name, part, words, windows``: folded item texts in parts that overlap by a window less one."""

    def cut(texts: list[bytes]) -> list[list]:
        parts = []
        for value in texts:
            words = fold_words(value)
            starts = range(0, max(1, len(words) - window + 1), SEGMENT_WINDOWS)
            runs = [words[s : s + SEGMENT_WINDOWS + window - 1] for s in starts]
            parts.append([{"words": b" ".join(r), "windows": max(1, len(r) - window + 1)} for r in runs if r])
        return [parts]

    named = benchmark.select(quoted(item).cast("string").alias("name"), quoted(text).alias("text")).distinct()
    cut_up = append_columns(named, "text", "parts array<struct<words: binary, windows: bigint>>", cut)
    return cut_up.select("name", F.posexplode("parts").alias("part", "p")).select("name", "part", "p.words", "p.windows")


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_windows: int = SHARD_WINDOWS,
) -> DataFrame:
    """Append ``n_words``, ``hit_spans``, ``n_hit``, ``items`` and ``contaminated``.

    ``hit_spans`` are merged word spans ``struct<start, end>`` inside any
    occurrence of a benchmark window, ``items`` the sorted names of the items
    with occurring windows. Null and empty texts have no words on either side;
    items with equal names count as one, an item without a name marks words but
    is not listed. Rows are neither dropped nor repeated; an empty benchmark
    marks nothing; clashing input columns are replaced.
    """
    spark = df.sparkSession
    parts = store(_segments(benchmark, item, item_text, window), "windows")
    total = parts.agg(F.sum("windows")).first()[0] or 0
    shards = max(1, -(-total // shard_windows))
    if shards == 1:
        return _counted(_search(df, parts, text, window))
    rows = store(df.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = None
    for shard in range(shards):
        own = parts.where(F.pmod(F.xxhash64("name", "part"), F.lit(shards)) == shard)
        hits = _search(rows.select("_row", quoted(text).alias("_text")), own, "_text", window)
        hits = hits.where(F.size("hit_spans") > 0).select("_row", "hit_spans", "items")
        hits = store(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    # at most one row per document and shard
    found = found.groupBy("_row").agg(
        F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")
    )
    joined = append_columns(rows, text, "n_words bigint", lambda texts: [[len(fold_words(t)) for t in texts]])
    joined = joined.join(found, "_row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.coalesce(_merged_spans(F.col("_spans")), none)
    items = F.array_sort(F.array_distinct(F.coalesce("_items", F.array().cast("array<string>"))))
    return _counted(with_columns(joined, {"hit_spans": spans, "items": items}).drop("_row", "_spans", "_items"))


def _merged_spans(spans) -> F.Column:
    def step(known, s):
        last = F.element_at(known, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(known, 1, F.size(known) - 1), F.array(wider))
        return F.when((F.size(known) > 0) & (s["start"] <= F.get(known, F.size(known) - 1)["end"]), grown).otherwise(
            F.concat(known, F.array(s))
        )

    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), start, step)


def _search(df: DataFrame, parts: DataFrame, text: str, window: int) -> DataFrame:
    # one shard: its windows are bounded by SHARD_WINDOWS
    segments = df.sparkSession.sparkContext.broadcast([(r["name"], bytes(r["words"])) for r in parts.select("name", "words").collect()])
    key = uuid.uuid4().hex

    def search(texts: list[bytes]) -> list[list]:
        searcher = _searcher(key, segments, window)
        counts, spans, names = [], [], []
        for value in texts:
            words = fold_words(value)
            own, items = searcher.find(words)
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in own])
            names.append(items)
        return [counts, spans, names]

    schema = "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>"
    return append_columns(df, text, schema, search)


def _counted(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    n_hit = F.aggregate("hit_spans", zero, lambda n, s: n + s["end"] - s["start"])
    return with_columns(df, {"n_hit": n_hit, "contaminated": n_hit > 0})
