"""The manifest against trees built by plain lists."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.merkle import build_manifest, field, fold, proof_digest, row_digest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value) -> str:
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def climb(leaves: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per leaf its (left, right) siblings level by level."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]
    level, own = leaves, list(range(len(leaves)))
    while len(level) > 1:
        for leaf, at in enumerate(own):
            run = at - at % arity
            proofs[leaf].append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        own = [at // arity for at in own]
    return level[0], proofs


def plain(rows, arity=3):
    """(group, key, leaf) rows → (group, key, leaf, subroot, root, proof) rows."""
    first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    groups: dict = {}
    for row in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2])):
        groups.setdefault(row[0], []).append(row)
    trees = [climb([r[2] for r in members], arity) for members in groups.values()]
    root, above = climb([subroot for subroot, _ in trees], arity)
    return [
        (*row, subroot, root, tuple(proof + upper))
        for members, (subroot, proofs), upper in zip(groups.values(), trees, above)
        for row, proof in zip(members, proofs)
    ]


def manifest(spark, rows, arity=3):
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string")
    got = build_manifest(df, "source", ["doc_id"], arity=arity)
    assert got.columns == ["source", "doc_id", "leaf", "subroot", "root", "proof"]
    return [(*r[:5], tuple(tuple(p) for p in r["proof"])) for r in got.collect()]


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("sizes", [(1,), (2,), (4,), (9, 1), (10, 3, 1, 28), (1, 1, 1, 1, 2), (82, 27)])
def test_trees(spark, arity, sizes):
    names = [None, "Z", "a", "ä", "𐐷"]
    rows = [(names[g], 1000 - i * 7, h(f"{g}/{i}")) for g, n in enumerate(sizes) for i in range(n)]
    assert sorted(manifest(spark, rows, arity), key=repr) == sorted(plain(rows, arity), key=repr)


def test_ties_and_repeated_rows(spark):
    rows = [("s", None, h("x")), ("s", None, h("x")), ("s", 1, h("b")), ("s", 1, h("a")), (None, None, h("c")), ("", 5, h("d"))] + [("s", 4, h("e"))] * 7
    got, wanted = manifest(spark, rows), plain(rows)
    assert Counter(r[:5] for r in got) == Counter(r[:5] for r in wanted)
    assert Counter(map(repr, got)) == Counter(map(repr, wanted))
    assert manifest(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("s", 1, h("a"), "old", 5, "q")], "source string, doc_id int, leaf string, Root string, idx int, `a.b` string")
    got = build_manifest(df, "source", ["doc_id"])
    assert got.columns == ["source", "doc_id", "leaf", "idx", "a.b", "subroot", "root", "proof"]
    row = got.first()
    assert row["root"] == row["subroot"] == h("a") and row["proof"] == [] and row["idx"] == 5


def test_fields_and_folding(spark):
    df = spark.createDataFrame([(None, "ä:1", -5), (3, "", None)], "a long, b string, c int")
    got = [tuple(r) for r in df.select(field(F.col("a")), field(F.col("b")), field(F.col("c")), row_digest([F.col(c) for c in "abc"])).collect()]
    assert got == [("-", "4:ä:1", "2:-5", h("-", "4:ä:1", "2:-5")), ("1:3", "0:", "-", h("1:3", "0:", "-"))]
    kind = "leaf string, proof array<struct<left:string,right:string>>"
    one = spark.createDataFrame([(h("m"), [(h("l"), h("r")), ("", ""), ("", h("t"))]), (h("m"), [])], kind)
    steps = h(h(h(h("l"), h("m"), h("r"))), h("t"))
    assert [tuple(r) for r in one.select(fold(F.col("leaf"), F.col("proof")), proof_digest(F.col("proof"))).collect()] == [
        (steps, h(h("l"), h("r"), h("t"))), (h("m"), h(""))]


def test_levels_join_by_index(spark):
    """A group with every row is dealt by the index inside its tree, never by the group."""
    from metricweave.llm.merkle import parents

    nodes = spark.range(5000).select(F.lit(1).cast("bigint").alias("tree"), F.col("id").alias("idx"), F.lit(5000).cast("bigint").alias("nodes"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above = parents(nodes, 3)
        assert above.count() == 1667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fields = lambda r, text: h(*[written(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
    wanted = {r[1]: r for r in plain([(r["source"], r["doc_id"], fields(r, r["text"])) for r in docs])}
    tampered = {
        r["doc_id"]: fields(r, r["text"].replace("\n", "") if zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]) for r in docs
    }
    got = LLM_QUERIES["op12_merkle_manifest"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        _, _, leaf, subroot, root, proof = wanted[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == h(*[x for p in proof for x in p])
        folded = tampered[r["doc_id"]]
        for left, right in proof:
            folded = h(left, folded, right)
        assert r["folded_root"] == folded and r["verified"] == (folded == root)
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] == (tampered[r["doc_id"]] == r["leaf"]) for r in got)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a\n\nb" * 9000, None, "s", 5), (4, "\n", "x", "", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, given in (("some", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = LLM_QUERIES["op12_merkle_manifest"](spark, str(tmp_path / name)).collect()
        assert sorted((r["doc_id"] or 0) for r in got) == sorted((r[0] or 0) for r in given)
        assert all(r["verified"] for r in got if r["doc_id"] is None)
