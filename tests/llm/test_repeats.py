"""Removal of repeated byte strings against a table of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from metricweave.llm import repeats
from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.refinement import repeated_starts
from metricweave.llm.repeats import anchors, reach, remove_repeats


def plain(texts: list[bytes], span: int) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        rest = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def got(df, span):
    rows = remove_repeats(df, span=span).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def texts(rng: random.Random) -> list[str]:
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = say(30), say(120)
    made = [say(rng.randint(1, 150)) for _ in range(40)]
    made += [f"{say(rng.randint(0, 20))}{passage}{say(rng.randint(0, 20))}" for _ in range(25)]
    for _ in range(25):
        near = base.split(" ")
        for _ in range(3):
            near[rng.randrange(len(near))] = rng.choice(words)
        made.append(" ".join(near))
    return made + [base, base, "", "ab" * 400, "a" * 700, "a" * 39, "a" * 40, passage[5:60] + "é" + passage[5:60]]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", 512)
    made = texts(random.Random(seed))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string").repartition(3)
    expected = plain([t.encode() for t in made], 40)
    assert got(df, 40) == dict(enumerate(expected))


def test_query_against_all_windows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = plain([(r["text"] or "").encode() for r in rows], 200)
    out = {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in LLM_QUERIES["op8_repeats"](spark, sf_dir).collect()
    }
    assert out == {r["doc_id"]: e for r, e in zip(rows, expected)}


def test_anchors_depend_on_content_only():
    text = random.Random(3).randbytes(5000)
    blocks = anchors(text + b"xyz" + text, np.array([5003, 10003]), 200)
    place, first, last = (np.concatenate(x) for x in zip(*blocks))
    serves = {i: p for p, a, b in zip(place, first, last) for i in range(a, b + 1)}
    assert set(serves) == {*range(5003 - 199), *range(5003, 10003 - 199)}
    assert all(0 <= p - i <= reach(200) for i, p in serves.items())
    assert all(serves[i] + 5003 == serves[i + 5003] for i in range(5000 - 199))


@pytest.mark.parametrize("span", [8, 11, 40])
def test_refinement_of_all_suffixes(spark, span):
    made = [t.encode() for t in texts(random.Random(5))]
    seen = Counter(t[i : i + span] for t in made for i in range(len(t) - span + 1))
    expected = sorted((k, i) for k, t in enumerate(made) for i in range(len(t) - span + 1) if seen[t[i : i + span]] > 1)
    df = spark.createDataFrame(list(enumerate(made)), "text_id bigint, text binary")
    assert sorted(map(tuple, repeated_starts(df, span).collect())) == expected


def test_few_letters_make_few_rows(spark):
    """Twenty megabytes of one byte, and a text of a short period: anchors that agree are one row."""
    long = "a" * 20_000_000
    rows = [(1, long), (2, "ab" * 300_000), (3, "a" * 199 + "b"), (4, "b" + "a" * 300)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    kept = df.selectExpr("doc_id AS text_id", "CAST(text AS BINARY) AS text").mapInArrow(repeats._anchor_rows(200), repeats._ANCHORS)
    assert kept.count() < 600_000
    out = got(df, 200)
    assert out[1][:3] == (20_000_000, 20_000_000, 1) and out[2][:3] == (600_000, 600_000, 1)
    assert out[3][:3] == (200, 0, 0) and out[4][:3] == (301, 300, 1)


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "x" * 199, 3), (2, "x" * 199, 3), (3, "y" * 200, 4), (3, "y" * 200, 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_bytes int")
    out = remove_repeats(df, keep_bytes=True).orderBy("n_bytes").collect()
    assert [(r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out] == [
        (0, 0, b""), (0, 0, b""), (199, 0, b"x" * 199), (199, 0, b"x" * 199), (200, 200, b""), (200, 200, b""),
    ]
    assert remove_repeats(df.limit(0)).count() == 0
