"""SimHash against all pairs, and the pieces of the comparison on their own."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from metricweave.llm import simhash
from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.components import components
from metricweave.llm.simhash import fingerprint, near_duplicates, near_lanes, near_links, planes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(FOLD)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots_of(prints: list[int], radius: int = 3) -> dict[int, int]:
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= radius:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("text", ["", " \n ", "One", "One two", "A b C d", "é È\xa0x  y\tz", "x " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def near_set(rng: random.Random, centres: int, around: int, flips: int) -> list[int]:
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(around):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << bit
            found.add(x)
    return sorted(found)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_near_lanes_counts_bits(radius):
    rng = random.Random(radius)
    values = np.array(near_set(rng, 8, 16, 6)[:128] or [0], dtype="<u8")
    lanes = np.zeros(128, dtype="<u8")
    lanes[: len(values)] = values
    every = np.full((len(values), 2), ~np.uint64(0))
    bits = np.unpackbits(near_lanes(values, planes(lanes), every, radius).view(np.uint8), axis=1, bitorder="little")
    for i, x in enumerate(values):
        assert [bool(b) for b in bits[i]] == [(int(x) ^ int(y)).bit_count() <= radius for y in lanes]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 8])
def test_links_keep_all_components(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = near_set(random.Random(7), 30, 25, 4)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = components(near_links(spark.createDataFrame(signed, "fp bigint"))).collect()
    expected = roots_of([s[0] % (1 << 64) for s in signed])
    got = {r["node"] % (1 << 64): r["root"] for r in nodes}
    classes: dict[int, set] = {}
    for p, r in expected.items():
        classes.setdefault(r, set()).add(p)
    found: dict[int, set] = {}
    for p in expected:
        found.setdefault(got.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}


def test_query_matches_all_pairs(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    roots = roots_of(sorted(set(prints.values())))
    least: dict[int, int] = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    rows = LLM_QUERIES["op4_simhash"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (d, f"{p:016x}", least[roots[p]]) for d, p in prints.items()
    }


def test_edges(spark):
    rows = [(None, None, "a"), (3, "", "b"), (3, "", "b"), (None, "one two three four", "c"), (9, "One two three four", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chosen string")
    out = near_duplicates(df).collect()
    assert sorted((r["component_id"], r["chosen"]) for r in out) == [(3, False), (3, False), (3, True), (9, False), (9, True)]
    empty = near_duplicates(df.limit(0))
    assert empty.columns == ["doc_id", "text", "simhash", "component_id", "chosen"] and empty.isEmpty()
