"""A Merkle manifest: one tree per group of rows, and one over the groups' roots.

Every level is one table of nodes. Its heads, the nodes in slot zero of a run, find
their siblings by equijoins on computed indices (exclusive or for binary trees, slot
offsets otherwise) and emit the parents, which are the next level. Nodes of one tree
are spread by their index, so a group with a third of all rows is no hot key.

The way down gives every node its proof: the siblings on its own level before those
of its parent. No level, no path and no list of digests passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from metricweave.llm.columns import quoted
from metricweave.operators.numbering import number_rows
from metricweave.session import drop_scratch, store

PROOF = "array<struct<left:string,right:string>>"


def digest(parts: Sequence[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated parts, digests as their text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row's fields; no two different rows write the same fields."""
    return digest([field(c) for c in columns])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda seen, run: digest([run["left"], seen, run["right"]]))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, leaf level first, each level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def parents(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree, idx, nodes, digest`` of the level above, with the ``children`` of each node.

    ``nodes`` has ``tree, idx, nodes, digest``, where column ``nodes`` counts the
    tree's nodes on this level and ``idx`` numbers them from 0.
    """
    slot = F.pmod("idx", F.lit(arity))
    heads = nodes.where(slot == 0).select("tree", "idx", "nodes", F.col("digest").alias("child_0"))
    for k in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")) if arity == 2 else F.col("idx") - k
        siblings = nodes.where(slot == k).select("tree", at.alias("idx"), F.col("digest").alias(f"child_{k}"))
        heads = heads.join(siblings, ["tree", "idx"], "left")
    children = F.array_compact(F.array(*[f"child_{k}" for k in range(arity)]))
    size = F.lit(arity).cast("bigint")
    return heads.select(
        "tree",
        F.call_function("div", F.col("idx"), size).alias("idx"),
        F.call_function("div", F.col("nodes") + (arity - 1), size).alias("nodes"),
        F.sha2(F.array_join(children, ""), 256).alias("digest"),
        children.alias("children"),
    )


def climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``leaves`` and the roots, ``tree, height, digest``.

    Each level is written once; there are as many as the logarithm of the largest
    tree, and none where every tree is a single leaf.
    """
    levels, nodes, roots = [], leaves, []
    tallest = leaves.agg(F.max("nodes")).first()[0] or 1
    while True:
        roots.append(nodes.where("nodes = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        if tallest <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        levels.append(store(parents(nodes.where("nodes > 1"), arity), "level"))
        nodes, tallest = levels[-1], -(-tallest // arity)


def descend(levels: list[DataFrame], starts: DataFrame, arity: int) -> DataFrame:
    """Proof of every leaf from that of its root.

    ``starts`` has ``tree, height, proof`` and other columns, which every leaf of the
    tree gets; the result has ``tree, idx, proof`` and those.
    """
    carried = [c for c in starts.columns if c not in ("tree", "height", "proof")]

    def begun(height: int) -> DataFrame:
        rows = starts.where(F.col("height") == height)
        return rows.select("tree", F.lit(0).cast("bigint").alias("idx"), "proof", *carried)

    paths = begun(len(levels))
    for height in reversed(range(len(levels))):
        runs = levels[height].select("tree", "idx", "children").join(paths, ["tree", "idx"])
        each = runs.select("tree", "idx", "proof", *carried, "children", F.posexplode("children").alias("slot", "_child"))
        around = F.struct(
            F.array_join(F.slice("children", F.lit(1), F.col("slot")), "").alias("left"),
            F.array_join(F.slice("children", F.col("slot") + 2, F.lit(arity)), "").alias("right"),
        )
        below = each.select(
            "tree", (F.col("idx") * arity + F.col("slot")).alias("idx"), F.concat(F.array(around), "proof").alias("proof"), *carried
        )
        paths = below.unionByName(begun(height))
    return paths


def build_manifest(df: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", arity: int = 3) -> DataFrame:
    """Append ``subroot``, ``root`` and ``proof`` to rows that carry their digest in ``leaf``.

    Rows of one ``group`` are the leaves of one tree, in ascending ``order`` (nulls
    first; equal keys by digest, and equal rows stand side by side); every ``arity``
    consecutive nodes have one parent until one is left. The groups' roots, in
    ascending byte order of the group, null first, are the leaves of the last tree.
    A row's ``proof`` holds, level by level up to the root, the siblings left and right
    of its node; it is empty where group and table are one row. No row is dropped,
    an empty table gives an empty manifest. Input columns with the names of the
    appended ones, in any case, are replaced.

    The levels are written while the query is being defined, one job each.
    """
    taken = {"subroot", "root", "proof"}
    kept = [c for c in df.columns if c.lower() not in taken]
    boxed = df.select(
        quoted(group).alias("grouped"),
        *[quoted(c).alias(f"key_{i}") for i, c in enumerate(order)],
        quoted(leaf).alias("digest"),
        F.struct(*[quoted(c) for c in kept]).alias("record"),
    )
    keys = ["grouped", *[f"key_{i}" for i in range(len(order))], "digest"]
    numbered = number_rows(boxed, keys, "number", unique=False)
    # a tree is named by the number of its first row, which also puts the trees in order
    trees = store(
        numbered.groupBy("grouped").agg(F.min("number").alias("tree"), F.count(F.lit(1)).alias("nodes")), "trees"
    )
    member = F.col("n.grouped").eqNullSafe(F.col("t.grouped"))
    leaves = store(
        numbered.alias("n").join(trees.alias("t"), member).select(
            "tree", (F.col("number") - F.col("tree")).alias("idx"), "nodes", "digest", "record"
        ),
        "leaves",
    )
    # what has been written on is not read again
    drop_scratch(numbered)
    levels, roots = climb(leaves.drop("record"), arity)
    subroots = number_rows(roots, ["tree"], "place")
    count = F.lit(trees.count()).cast("bigint")
    tops = store(
        subroots.select(F.lit(0).cast("bigint").alias("tree"), (F.col("place") - 1).alias("idx"), count.alias("nodes"),
                        "digest", F.col("tree").alias("below"), "height"),
        "subroots",
    )
    upper, top = climb(tops.select("tree", "idx", "nodes", "digest"), arity)
    first = top.select("tree", "height", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    above = descend(upper, first, arity)
    starts = store(
        tops.join(above, ["tree", "idx"]).select(F.col("below").alias("tree"), "height", "proof", F.col("digest").alias("subroot"), "root"),
        "starts",
    )
    proved = leaves.select("tree", "idx", "record").join(descend(levels, starts, arity), ["tree", "idx"])
    return proved.select(*[F.col("record").getField(c).alias(c) for c in kept], "subroot", "root", "proof")
