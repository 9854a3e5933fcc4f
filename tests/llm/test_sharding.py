"""Shards against a plain two-pass shuffle, and the law of their sizes."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricweave.llm import sharding
from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.sharding import scatter_hash, shuffle_into_shards, write_shards
from metricweave.session import scratch_path, store


def fisher_yates(items: list, seed: int) -> list:
    """A plain Fisher-Yates shuffle, inside out, with a Mersenne twister."""
    state = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])
    draw = lambda: int(state.randint(0, 1 << 32, dtype=np.uint32)) >> 1

    def below(n: int) -> int:
        if n & -n == n:
            return n * draw() >> 31
        while True:
            bits = draw()
            value = bits % n
            if bits - value + (n - 1) < 1 << 31:
                return value

    out = []
    for i, item in enumerate(items):
        j = below(i + 1)
        out.append(item)
        out[i], out[j] = out[j], item
    return out


def check_law(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_against_a_plain_shuffle(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    drawn = {r["doc_id"]: r["h"] for r in df.select("doc_id", scatter_hash(df, 9).alias("h")).collect()}
    size = sum(i % 90 + 1 + sharding.ROW_BYTES for i in range(500))
    count = -(-size // 9000)
    assert count > 3
    buckets = [sorted((i for i in drawn if drawn[i] % count == b), key=drawn.get) for b in range(count)]
    wanted = [i for b, members in enumerate(buckets) for i in fisher_yates(members, 9 + b)]
    got = shuffle_into_shards(df, 8, 9, bucket_bytes=9000).collect()
    check_law(got, 8)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == wanted
    assert [sum(map(len, buckets[:k])) for k in range(3)] != [0, 0, 0]
    again = shuffle_into_shards(df, 8, 9, bucket_bytes=9000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = shuffle_into_shards(df, 8, 10, bucket_bytes=9000).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_query(spark, sf_dir):
    got = LLM_QUERIES["op11_sharding"](spark, sf_dir).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(docs.keys())
    check_law(got, 8)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_nothing_keeps_its_place(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = shuffle_into_shards(df, 4, bucket_bytes=40_000).collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.08
    by_shard = Counter((r["shard"], r["doc_id"] // 1000) for r in got)
    assert all(170 < n < 330 for n in by_shard.values())


ODD = "doc_id bigint, text string, Shard string, slot int, bucket int, `a.b` string, m map<string,int>"


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_odd_rows(spark, shards):
    rows = [(None, None, "s", 1, 5, "q", {"k": 1}), (1, "", None, None, None, None, None), (1, "", None, None, None, None, None)]
    rows += [(2, "ä" * 50_000, "s", 2, 6, "r", None), (None, None, "s", 1, 5, "q", {"k": 1})]
    df = spark.createDataFrame(rows, ODD)
    got = shuffle_into_shards(df, shards, bucket_bytes=64)
    assert got.columns == ["doc_id", "text", "bucket", "a.b", "m", "shard", "slot"]
    rows_ = got.collect()
    check_law(rows_, shards)
    kept = Counter((r[0], r[1], r[2], r[3], str(r[4])) for r in rows_)
    assert kept == Counter((r[0], r[1], r[4], r[5], str(r[6])) for r in rows)
    empty = shuffle_into_shards(df.limit(0), shards)
    assert empty.count() == 0 and empty.columns == got.columns


def test_equal_rows_are_spread(spark, monkeypatch):
    """A third of all rows are wholly equal; no bucket gathers them."""
    kept = []
    monkeypatch.setattr(sharding, "store", lambda df, label: kept.append(store(df, label)) or kept[-1])
    same = spark.range(0, 3000, 1, 24).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("copy").alias("text"))
    other = spark.range(0, 6000, 1, 24).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    got = shuffle_into_shards(same.unionByName(other), 8, bucket_bytes=64_000).collect()
    check_law(got, 8)
    sizes = [r["count"] for r in kept[0].groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 900


def test_a_bucket_is_one_task(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    plan = shuffle_into_shards(df, 8)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharded, path = store(shuffle_into_shards(df, 3), "sharded"), scratch_path(spark, "shards")
    write_shards(sharded, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(sharded.columns).collect())) == sorted(map(tuple, sharded.collect()))
    placed = back.select("shard", "slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("f", "at").collect()
    for a, b in zip(placed, placed[1:]):
        assert a["f"] != b["f"] or (a["shard"], a["slot"] + 1) == (b["shard"], b["slot"])
