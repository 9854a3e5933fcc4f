"""Packing token sequences: repeat counts of length combinations by non-negative least squares.

Documents are tokenised once. Whole windows are cut off as pieces of their own;
the tails are packed. Only the histogram of tail lengths, one number per length
below the window, comes to the driver: shallow combinations of lengths that fill
a window are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded, and what remains is packed greedily,
again by counts per length. The plan has a size set by the window, not by the
table; every piece finds its place in it by its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from metricweave.llm.arrow import append_columns
from metricweave.llm.columns import quoted
from metricweave.session import store

WINDOW, END_ID = 4096, 2
#: Rounds of the fit, and the largest number of pieces in an enumerated combination.
ROUNDS, DEPTH = 200, 4
#: Second lengths tried per largest length, and third ones per pair, spread evenly over what fits.
STEPS = (6, 2)
#: A combination is enumerated if it fills this share of the window.
FILLED = 0.98
#: Words whose ids a worker remembers before it starts anew, with these as a second choice.
REMEMBERED = 500_000

_TOKENIZERS: dict[str, "WordTokenizer"] = {}


#: How the lower-casing word tokenizer cuts printable Latin-1; fixed value of its file.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªºµß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªºµß-öø-ÿ0-9²³¹¼-¾]+")
_PROBES = ("Don't we'll go?", "A1b22!!c", "x<y>z_w--'s's", "[#$%&*]e.g.,ABC's", "'tis 'D're", "Äpfel, ÇA¿ñÿ³×÷ß½ª")


def _byte_chars() -> dict[int, str]:
    """The character that stands for a byte: itself if it prints, else the next beyond Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words as little-endian 32-bit numbers, looked up, else taken from an older memory, else made."""

    def __init__(self, make, older: dict[bytes, bytes]):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        self[word] = found = self.make(word) if found is None else found
        return found


class WordTokenizer:
    """Ids of whole texts, word by word.

    For tokenizers that drop white space and never join text across it: the ids
    of a text are those of its runs between ASCII white space, which are looked
    up or encoded once and remembered. A printable Latin-1 word may skip the
    tokenizer's alignment of offsets and go to its model piece by piece; that
    way is only taken if it gives the tokenizer's own ids on a few probes.
    """

    def __init__(self, path: str):
        # the tasks of a worker are the parallelism
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.chars = _byte_chars()
        self.piece = lru_cache(maxsize=REMEMBERED // 8)(self._piece)
        self.known = _Words(self._word, {})
        words = [w for probe in _PROBES for w in probe.split()]
        self.quick = all(self._pieces(w) == self._whole(w) for w in words)

    def _whole(self, word: str) -> bytes:
        return self._packed(self.inner.encode(word, add_special_tokens=False).ids)

    @staticmethod
    def _packed(ids: Sequence[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.chars.__getitem__, piece.encode()))
        return self._packed([token.id for token in self.model.tokenize(piece)])

    def _pieces(self, word: str) -> bytes:
        return b"".join(map(self.piece, _CUT.findall(word.lower())))

    def _word(self, word: bytes) -> bytes:
        told = word.decode("utf-8", "replace")
        plain = self.quick and told.isprintable() and (told.isascii() or max(told) <= "\xff") and not self.special(told)
        return self._pieces(told) if plain else self._whole(told)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known = _Words(self._word, self.known)
            self.known.older.older = {}
        find = self.known.__getitem__
        return [b"".join(map(find, text.split())) for text in texts]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(df: DataFrame, tokenizer_path: str, text: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the input's columns without ``text``, then ``start, length,
    ids_crc32, doc_tokens`` and, if asked for, ``ids``.

    A document is its ids and END_ID; it is cut into whole windows and a tail. A
    null or empty text is the one id END_ID.
    """
    fields = "start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint" + ", ids: array<bigint>" * keep_ids

    def cut(texts: list[bytes]) -> list[list]:
        rows = []
        for packed in tokenizer(tokenizer_path).encode(texts):
            packed += END_ID.to_bytes(4, "little")
            pieces = []
            for start in range(0, len(packed) // 4, window):
                own = packed[4 * start : 4 * (start + window)]
                piece = {"start": start, "length": len(own) // 4, "ids_crc32": zlib.crc32(own), "doc_tokens": len(packed) // 4}
                pieces.append(piece | ({"ids": np.frombuffer(own, dtype="<u4").tolist()} if keep_ids else {}))
            rows.append(pieces)
        return [rows]

    names = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kept = [c for c in df.columns if c.lower() not in {*names, text.lower(), "_pieces"}]
    cut_up = append_columns(df.select(*map(quoted, kept), quoted(text)), text, f"_pieces array<struct<{fields}>>", cut)
    exploded = cut_up.select(*map(quoted, kept), F.explode("_pieces").alias("_piece"))
    return exploded.select(*map(quoted, kept), *[F.col(f"_piece.{n}") for n in names])


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to DEPTH lengths, each at most the window, that fill it or nearly so.

    For every length as the largest, the others are taken from a spread of
    STEPS values, and the last is the longest present length that still fits.
    Zero stands for no piece. There are at most 20 rows per length.
    """
    below = np.searchsorted(present, np.arange(window + 1), side="right") - 1
    floor = np.where(below >= 0, present[np.maximum(below, 0)], 0)  # longest present length up to an index
    made = [np.stack([present, floor[window - present]], axis=1)]
    partial, left = present[:, None], window - present
    for depth in range(2, DEPTH):
        shares = (np.arange(STEPS[depth - 2]) + 0.5) / STEPS[depth - 2]
        more = floor[(left[:, None] * shares[None, :]).astype(int)]
        partial = np.concatenate([np.repeat(partial, len(shares), axis=0), more.reshape(-1, 1)], axis=1)
        left = np.repeat(left, len(shares)) - more.reshape(-1)
        fits = more.reshape(-1) > 0
        partial, left = partial[fits], left[fits]
        made.append(np.concatenate([partial, floor[left][:, None]], axis=1))
    wide = np.zeros((sum(map(len, made)), DEPTH), dtype=np.int64)
    at = 0
    for rows in made:
        wide[at : at + len(rows), : rows.shape[1]] = rows
        at += len(rows)
    return np.unique(-np.sort(-wide[wide.sum(axis=1) >= FILLED * window], axis=1), axis=0)


def fit_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squares of (pieces used - pieces there).

    Multiplicative updates: the matrix has no negative entry, so each step keeps
    x non-negative and never worsens the fit. Products touch only the DEPTH
    lengths of a combination.
    """
    counts = histogram.astype(float)
    counts[0] = 0
    x = np.full(len(combos), counts.sum() / len(combos))
    ask, entries = counts[combos].sum(axis=1), combos.ravel()
    for _ in range(rounds):
        used = np.bincount(entries, np.repeat(x, combos.shape[1]), len(counts))
        used[0] = 0
        x = x * ask / np.maximum(used[combos].sum(axis=1), 1e-9)
    return x


def plan(histogram: Sequence[int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)``: every piece of the histogram in exactly one sequence.

    ``histogram[n]`` is the number of pieces of length n, up to the window.
    """
    left = np.array(histogram, dtype=np.int64)
    made: list[tuple[tuple[int, ...], int]] = []
    present = np.flatnonzero(left[:window])
    combos = combinations(present, window) if len(present) else present
    if len(combos):
        wanted = fit_counts(combos, left)
        for at in np.lexsort((-combos.sum(axis=1), -wanted)):
            repeats = int(wanted[at])
            if repeats < 1:
                break
            need = Counter(int(n) for n in combos[at] if n)
            repeats = min(repeats, *(int(left[n]) // k for n, k in need.items()))
            if repeats > 0:
                for n, k in need.items():
                    left[n] -= k * repeats
                made.append((tuple(int(n) for n in combos[at] if n), repeats))
    return made + _greedy(left, window)


def _greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest first, each sequence filled with the largest pieces that still fit.

    Works on counts: a sequence is repeated as often as its lengths allow, so
    every step uses up at least one length.
    """
    made = []
    present = [int(n) for n in np.flatnonzero(left)]
    while present:
        taken: Counter[int] = Counter()
        room, order = window, []
        at = len(present) - 1
        while at >= 0 and room > 0:
            n = present[at]
            fit = min(room // n, int(left[n]))
            if fit:
                taken[n] = fit
                order += [n] * fit
                room -= n * fit
            at = min(at - 1, int(np.searchsorted(present, room, side="right")) - 1)
        repeats = min(int(left[n]) // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= k * repeats
        made.append((tuple(order), repeats))
        present = [n for n in present if left[n]]
    return made


def _plan_rows(made: list[tuple[tuple[int, ...], int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``length, first rank, last rank + 1, first sequence, pieces per sequence, offset``."""
    used: Counter[int] = Counter()
    sequence = 0
    for lengths, repeats in made:
        offset = 0
        for n, k in Counter(lengths).items():
            yield n, used[n], used[n] + k * repeats, sequence, k, offset
            used[n] += k * repeats
            offset += n * k
        sequence += repeats


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, gapless from 0 in a sequence.

    Every id lies in exactly one piece, and no sequence exceeds ``window``. Rows
    are neither dropped nor merged: a repeated row is packed again, a null text
    is the end id alone, an empty table gives no pieces. Input columns named
    like the piece's are replaced, ``text`` is left out.
    """
    spark = df.sparkSession
    pieces = cut_pieces(df, tokenizer_path, text, window, keep_ids)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    names = pieces.columns
    pieces = store(pieces.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    salt = F.pmod(F.xxhash64("_place"), F.lit(salts)).cast("int")
    counts = store(pieces.groupBy("length", salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_n")), "lengths")

    histogram = [0] * (window + 1)
    # one row per length
    for length, n in counts.groupBy("length").agg(F.sum("_n")).collect():
        histogram[length] = n
    rows = list(_plan_rows(plan(histogram, window)))

    # at most ``salts`` rows per length meet in a window, and each group of one length and salt is a share of the table
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("_place")
    ranked = pieces.withColumn("_salt", salt).withColumn("_own", F.row_number().over(own) - 1)
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))

    # the plan's size is bounded by the combinations of a window
    places = spark.sparkContext.broadcast(_by_length(rows))
    kept = [c for c in names if c.lower() not in ("sequence_id", "offset")]
    fields = [ranked.schema[c] for c in kept]
    out = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(len(kept) + i).to_numpy() for i in range(2))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                own = length == n
                last, first, start, k, begin = places.value[int(n)]
                row = np.searchsorted(last, rank[own], side="right")
                step = rank[own] - first[row]
                sequence[own] = start[row] + step // k[row]
                offset[own] = begin[row] + step % k[row] * n
            columns = [*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    wanted = ranked.select(*map(quoted, kept), F.col("length").alias("__length"), F.col("_rank").alias("__rank"))
    return wanted.mapInArrow(place, out)


def _by_length(rows) -> dict[int, np.ndarray]:
    grouped: dict[int, list[tuple[int, ...]]] = {}
    for length, *entry in rows:
        first, last, sequence, k, offset = entry
        grouped.setdefault(length, []).append((last, first, sequence, k, offset))
    return {n: np.array(entries, dtype=np.int64).T.copy() for n, entries in grouped.items()}
