"""Packing: every id in one piece, no overfull sequence, little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.packing import WordTokenizer, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece_once(lengths):
    histogram = np.bincount(np.array(lengths, dtype=int), minlength=65)
    used = np.zeros(65, dtype=int)
    for pieces, repeats in plan(histogram.tolist(), 64):
        assert 0 < sum(pieces) <= 64 and repeats > 0
        for n in pieces:
            used[n] += repeats
    assert (used == histogram).all()


def test_plan_pads_little_and_stays_small():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.6, 1.1, 400_000), 1, 4095).astype(int)
    made = plan(np.bincount(lengths, minlength=4097).tolist())
    sequences = sum(repeats for _, repeats in made)
    assert lengths.sum() / (sequences * 4096) > 0.995
    assert len(made) < 20 * 4096


TEXTS = ["", "  ", "It's don't a b　c 12 3\tx\ny", "ÀÉ é ΑΣ ς İ ß", "a<|endoftext|>b <|startoftext|>", "'s 're x'll 😀😀 ​", "word " * 900, "A%%% b***c's \x1cd\x00e __f_ <|g|> 'DON'T'S \x7f",
         " ".join(chr(a) + chr(b) + "'" + chr(a) for a in range(33, 127) for b in range(33, 127)),
         " ".join(chr(a) + "a" + chr(b) for a in range(33, 400) for b in range(128, 400))]


def test_word_tokenizer_equals_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    got = WordTokenizer(PATH).encode([t.encode() for t in TEXTS])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_word_tokenizer_on_real_words(sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()
    whole, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    assert own.quick
    for t, got in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def check(rows, texts):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(whole.encode(texts[doc] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence)


def test_query_covers_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = LLM_QUERIES["op7_packing"](spark, sf_dir).collect()
    sequences = check(rows, texts)
    assert sum(r["length"] for r in rows) / (sequences * 4096) > 0.98


@pytest.mark.parametrize("keep_ids", [False, True])
def test_edges(spark, keep_ids):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 9000, "c"), (None, "one two", "d"), (4, "x " * 4095, "e")]
    df = spark.createDataFrame(rows, "doc_id int, text string, offset string")
    out = pack(df, PATH, keep_ids=keep_ids)
    check(out.collect(), {r[0]: r[1] for r in rows})
    assert ("ids" in out.columns) == keep_ids
    twice = pack(df.unionAll(df), PATH)
    assert twice.count() == 2 * out.count()
    assert pack(df.limit(0), PATH).count() == 0
