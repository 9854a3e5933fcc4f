"""Every stage of the pipeline against a plain version of its decision."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricweave.llm.catalog import quality_sql
from compare import connect
from test_packing import check
from test_simhash import plain_fingerprint, roots_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), "test")
    return [*seen, docs]


def test_quality(stages, sf_dir):
    kept = {r[0] for r in connect(sf_dir).sql(f"SELECT doc_id FROM ({quality_sql()}) WHERE kept").fetchall()}
    assert set(by_id(stages[1])) == kept and stages[1].columns == COLUMNS


def test_one_of_each_group_stays(stages):
    prints = {d: plain_fingerprint(t) for d, t in by_id(stages[1]).items()}
    roots = roots_of(sorted(set(prints.values())))
    least: dict[int, int] = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    assert sorted(by_id(stages[2])) == sorted(least.values()) and stages[2].columns == COLUMNS


def test_contaminated_documents_go(stages, spark, sf_dir):
    fold = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t).lower().split(" ")
    words = lambda t: [w for w in fold(t) if w]
    windows = set()
    for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(row["text"])
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(" ".join(w[i : i + 10]) in windows for i in range(len(w) - 9))
    clean = {d for d, t in by_id(stages[2]).items() if not hit(words(t))}
    assert set(by_id(stages[3])) == clean


def test_personal_data_is_masked(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    assert not any("@mail" in t for t in after.values()) and any("[EMAIL]" in t for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not any(c.isdigit() for c in t))
    assert stages[4].where(F.col("n_chars") != F.length("text")).isEmpty()


def test_packing(stages):
    check(stages[5].collect(), by_id(stages[4]))


def test_stages_stand_odd_rows(spark, sf_dir):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "A b " * 3000, None, None, 5)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf_dir)
            assert name == "packing" or out.columns == COLUMNS
            assert out.count() >= 0
