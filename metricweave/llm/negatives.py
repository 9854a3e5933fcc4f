"""Hard negatives by exact inner products, over lists shared by clusters of anchors.

Anchors are clustered by direction. For a cluster, every candidate has an upper bound
that holds for all members: its length times the cosine of its angle to the centroid
less the cluster's own width. A block of candidates is sorted by that bound once per
cluster, and every member walks the list, taking exact integer scores, until the next
bound, times its own length, is below what its results still admit. That ends the walk
with a certificate; how tight the bounds are changes the work, never the rows.

Candidates lie in blocks and anchors in tiles, both of bounded size; a task holds one
block and one tile. The walks over the first block give every anchor a floor that it
carries into the others.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from metricweave.llm.columns import quoted
from metricweave.operators.numbering import number_rows
from metricweave.session import drop_scratch, store

#: Candidates per block, on average, and anchors per tile, at most.
BLOCK_ROWS, TILE_ANCHORS = 8192, 4096
#: Candidates whose scores are taken together: at first, and later.
FIRST_STEP, LAST_STEP = 64, 512
#: Passes of the clustering; more of them only tighten the bounds.
CLUSTER_PASSES = 5
#: Added to a cluster's width, far above the rounding of an arc cosine.
ANGLE_SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
WALKED = "anchor bigint, window int, score bigint, row bigint, vec_id bigint"


def quantised(vector: Column, scale: int) -> Column:
    """Every component as floor(scale * x), x taken as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))


def usable(vector: Column, scale: int) -> Column:
    """No null or non-finite component, and a squared length below 2^62, so that every score is a bigint."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    squares = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + F.floor(x * F.lit(float(scale))).cast("double") ** 2)
    return vector.isNotNull() & ~bad & (squares < float(1 << 62))


def prepare(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``row, vec_id, label, ints``, written: integer vectors of one width, short ones filled with zeros."""
    kept = df.select(
        quoted(key).cast("bigint").alias("vec_id"), quoted(label).cast("bigint").alias("label"), quoted(vector).alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"), scale))
    width = max(1, kept.agg(F.max(F.size("v"))).first()[0] or 0)
    ints = quantised(F.col("v"), scale)
    filled = F.concat(ints, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v")))
    return store(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", filled.alias("ints")), "vectors")


def tile_anchors(anchors: DataFrame, seed: int, tile_rows: int) -> DataFrame:
    """Append ``cluster`` and ``tile``: whole clusters side by side, cut where a tile is full."""
    count = anchors.count()
    vectors = anchors.withColumn("raw", array_to_vector(F.col("ints").cast("array<double>")))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(vectors)
    clusters = max(2, math.isqrt(count))
    model = KMeans(k=clusters, seed=seed, maxIter=CLUSTER_PASSES, predictionCol="cluster").fit(unit.select("features"))
    named = model.transform(unit).drop("raw", "features")
    numbered = number_rows(named, ["cluster", "row"], "place")
    tiles = store(numbered.withColumn("tile", ((F.col("place") - 1) / tile_rows).cast("int")).drop("place"), "tiles")
    drop_scratch(numbered)
    return tiles


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.empty(0, np.int64)])
    return flat.reshape(rows, -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where no partial sum can pass 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    longest = lambda m: math.sqrt(float((m.astype(np.float64) ** 2).sum(axis=1).max()))
    if longest(a) * longest(b) < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the candidates, their bounds per unit of member length, and their lengths, in that order."""
    lengths = lambda m: np.sqrt((m**2).sum(axis=1))
    own, other = lengths(members), lengths(candidates)
    centre = (members / np.maximum(own, 1e-300)[:, None]).sum(axis=0)
    size = math.sqrt(float((centre**2).sum())) or 1.0

    def angles(m: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(m @ centre / np.maximum(length * size, 1e-300), -1.0, 1.0))

    width = float(angles(members, own)[own > 0].max(initial=0.0)) + ANGLE_SLACK
    bounds = other * np.cos(np.maximum(angles(candidates, other) - width, 0.0))
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order], other[order]


def walk(
    members: np.ndarray, lows: np.ndarray, highs: np.ndarray, candidates: np.ndarray, ids: np.ndarray, allowed, keep: int
) -> tuple[np.ndarray, ...]:
    """The best ``keep`` candidates of every member and window: member, window, score, candidate.

    A window admits scores from ``lows`` to ``highs``. ``allowed(members, candidates)``
    masks pairs. Higher scores come first, ties by smaller id.
    """
    exact = members.astype(np.float64)
    order, bounds, lengths = shared_list(exact, candidates.astype(np.float64))
    own = np.sqrt((exact**2).sum(axis=1))
    # an empty window asks for nothing
    floors = np.where(lows <= highs, lows, HIGHEST)
    pool = [np.empty(0, np.int64) for _ in range(4)]
    active, at, step = np.arange(len(members)), 0, FIRST_STEP
    while at < len(order):
        # what follows is bounded by the next entry, lengths by the longest one left
        best = own[active] * bounds[at] + own[active] * lengths[at:].max() * 1e-9
        active = active[best >= floors[active].min(axis=1, initial=HIGHEST)]
        if not active.size:
            break
        chunk = order[at : at + step]
        scores = _products(members[active], candidates[chunk])
        fits = allowed(active, chunk)
        new = [pool]
        for w in range(lows.shape[1]):
            r, c = np.nonzero(fits & (scores >= floors[active, w][:, None]) & (scores <= highs[active, w][:, None]))
            new.append([active[r], np.full(len(r), w), scores[r, c], chunk[c]])
        pool = [np.concatenate(parts) for parts in zip(*new)]
        pool = _best(pool, ids, keep, floors)
        at, step = at + step, min(2 * step, LAST_STEP)
    return tuple(pool)


def _best(pool: list[np.ndarray], ids: np.ndarray, keep: int, floors: np.ndarray) -> list[np.ndarray]:
    """The first ``keep`` entries of each member and window; full ones raise their floor."""
    member, window, score, place = pool
    order = np.lexsort((ids[place], -score, window, member))
    group = member[order] * floors.shape[1] + window[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    last = order[rank == keep - 1]
    floors[member[last], window[last]] = score[last]
    kept = order[rank < keep]
    return [x[kept] for x in pool]


def _walk_cells(anchors: DataFrame, candidates: DataFrame, same: bool, keep: int) -> DataFrame:
    """All walks of anchors (``tile, block``) over candidates of the same cell."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
        if left.num_rows and right.num_rows:
            column = lambda t, name: t[name].to_numpy()
            wanted, vectors = _matrix(left["ints"], left.num_rows), _matrix(right["ints"], right.num_rows)
            lows, highs = _matrix(left["lows"], left.num_rows), _matrix(left["highs"], left.num_rows)
            rows, ids, labels = column(right, "row"), column(right, "vec_id"), column(right, "label")
            own_rows, own_labels, clusters = column(left, "row"), column(left, "label"), column(left, "cluster")
            for cluster in np.unique(clusters):
                at = np.flatnonzero(clusters == cluster)

                def allowed(m: np.ndarray, c: np.ndarray) -> np.ndarray:
                    alike = own_labels[at[m]][:, None] == labels[c][None, :]
                    return alike & (own_rows[at[m]][:, None] != rows[c][None, :]) if same else ~alike

                member, window, score, place = walk(wanted[at], lows[at], highs[at], vectors, ids, allowed, keep)
                for values, more in zip(out, (own_rows[at[member]], window, score, rows[place], ids[place])):
                    values.append(more)
        made = [np.concatenate(values) for values in out]
        kinds = {"anchor": pa.int64(), "window": pa.int32(), "score": pa.int64(), "row": pa.int64(), "vec_id": pa.int64()}
        return pa.table([pa.array(v, k) for v, k in zip(made, kinds.values())], names=list(kinds))

    return anchors.groupBy("tile", "block").cogroup(candidates.groupBy("tile", "block")).applyInArrow(cell, WALKED)


def _first(walked: DataFrame, keep: int) -> DataFrame:
    """Append ``rank`` from 1 among an anchor's and window's results, and keep the first ones."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return walked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(anchors: DataFrame, candidates: DataFrame, blocks: int, tiles: int, same: bool, keep: int) -> DataFrame:
    """The best ``keep`` candidates of each anchor and window, over all blocks.

    ``anchors`` carries ``lows`` and ``highs``, one entry per window; ``candidates``
    carries its ``block``. Every block meets every tile once.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    copies = candidates.withColumn("tile", numbers(tiles))
    first = anchors.withColumn("block", F.lit(0))
    begun = store(_first(_walk_cells(first, copies.where("block = 0"), same, keep), keep), "walked")
    if blocks == 1:
        return begun
    # a full result's last score bounds what any other block can add
    full = begun.where(F.col("rank") == keep).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full")
    )
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("full", w), low)))
    floored = anchors.join(full.withColumnRenamed("anchor", "row"), "row", "left")
    floored = floored.withColumn("lows", F.when(F.col("full").isNull(), F.col("lows")).otherwise(raised)).drop("full")
    rest = floored.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
    more = _walk_cells(rest, copies.where("block > 0"), same, keep)
    walked = store(_first(begun.drop("rank").unionByName(more), keep), "walked")
    drop_scratch(begun)
    return walked


def mine_negatives(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    block_rows: int = BLOCK_ROWS,
    tile_rows: int = TILE_ANCHORS,
    seed: int = 0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are integer inner products of the components' floor(scale * x). An anchor's
    positives are its first other rows of the same label, its negatives for a positive
    the first rows of another label that score from 80 to 100 % of the positive's score;
    higher scores come first, ties by smaller id, ranks from 1. ``is_anchor`` is a
    condition on ``vec_id``.

    Rows with a null id, label, vector or component, or a component that is not finite,
    take no part, nor do rows whose squared integer length reaches 2^62. Vectors shorter
    than the longest are filled with zeros; an empty one scores 0 with everything. Each
    row counts for itself, rows of one id or wholly equal rows too: a copy of an anchor
    may be its positive, and each copy of an anchor has rows of its own. A positive score
    below 0 admits no negative. Other columns are not read. An empty table, or one
    without anchors, gives no rows.

    Jobs run while the query is being defined: the clustering, whose driver sees only
    centroids (the square root of the number of anchors), and three of the four walks.
    """
    rows = prepare(df, key, vector, label, scale)
    blocks = max(1, -(-rows.count() // block_rows))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    anchors = rows.where(is_anchor)
    if anchors.isEmpty():
        return df.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        )
    tiled = tile_anchors(anchors, seed, tile_rows)
    tiles = (tiled.agg(F.max("tile")).first()[0] or 0) + 1

    limit = lambda value: F.array(F.lit(value).cast("bigint"))
    best = search(tiled.withColumns({"lows": limit(LOWEST), "highs": limit(HIGHEST)}), candidates, blocks, tiles, True, positives)
    # ceil(0.8 p) = p - floor(p / 5); a negative p admits nothing
    low = F.when(F.col("score") >= 0, F.col("score") - F.call_function("div", F.col("score"), F.lit(5).cast("bigint")))
    admitted = best.select(
        "anchor", "rank", "score", F.coalesce(low, F.lit(HIGHEST)).alias("low")
    ).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "score"))).alias("of"))
    # as many windows for every anchor; those beyond its positives admit nothing
    padded = lambda name, none: F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("of", i)[name], F.lit(none).cast("bigint"))
    )
    windows = admitted.select(
        F.col("anchor").alias("row"), padded("low", HIGHEST).alias("lows"), padded("score", LOWEST).alias("highs")
    )
    hard = search(tiled.join(windows, "row"), candidates, blocks, tiles, False, negatives)

    named = tiled.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = best.select(
        "anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    mined = hard.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(chosen, ["anchor", "window"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
