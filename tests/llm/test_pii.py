"""Personal data against plain regular expressions, and the masks."""

from __future__ import annotations

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.pii import BASE_PLAIN, LOOSE, candidates, find_pii, fit_span_model, mask_pii

TEXTS = [
    None,
    "",
    "no data here",
    "mail a.b+c@x-y.example.org, then _foo@z.org@w.net and x@y",
    "a@b.c_d@e.f.g@h @i.j k@ l@m.",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.255 0000255.1.2.3 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "call +1 (984) 555-5227 or +12 or ++49 30 123456 +1 +2 345 678 90 12 34 5",
    "é\U0001F600 +1 (984) 555-5227 \U0001F600 a@b.de 10.0.0.1",
    "1" * 30_000 + " " + "a" * 30_000 + "@b." + "c" * 5_000,
    " ".join(f"u{i}@h{i % 7}.example.com 10.0.{i % 300}.1" for i in range(700)),
    "0 - 1-2 3-4 5-6 7-8 9 0-1 2",
]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain_spans(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in BASE_PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_are_those_of_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for row in find_pii(df).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in row["pii"] if s["base"]]
        assert base == plain_spans(row["text"])


def test_query_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = LLM_QUERIES["op6_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = plain_spans(texts[row["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))
        assert row["n_email"] == sum(k == "email" for k, _, _ in expected)


def test_labelers_learn_what_to_add(spark):
    good = [(i, f"please call my phone (415) 555-{i:04d} now, or mail a{i}@b.org") for i in range(40)]
    bad = [(100 + i, f"see order 4000 1234 5678 {i:04d} on page 7") for i in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id int, text string")
    model = fit_span_model(df)
    assert set(model.reliability) == {"regex", "gazetteer", "context", "format"}
    kinds = {r["doc_id"]: {s["kind"] for s in r["pii"]} for r in find_pii(df, model=model).collect()}
    assert all(kinds[i] == {"email", "phone"} for i, _ in good)


def test_context_has_a_say(spark):
    """Loose forms are found where cues stand before or after them, and are not in rows of numbers."""
    rows, at = [], 0
    for i in range(60):
        told = [
            (f"reach us: support (at) mail{i}.org today", "email", f"support (at) mail{i}.org"),
            (f"please call (415) 555-{1000 + i} now", "phone", f"(415) 555-{1000 + i}"),
            (f"(415) 555-{2000 + i} is my phone", "phone", f"(415) 555-{2000 + i}"),
            (f"his ssn 219-09-{5000 + i} was", "ssn", f"219-09-{5000 + i}"),
            (f"order 415-555-{3000 + i} of page 3", None, None),
            (f"serial 4000 1234 5678 {1000 + i} and model", None, None),
            (f"row 204-555-{4000 + i}, 3021-9987, 7712", None, None),
            (f"write to a{i}@b.org or call +1 (984) 555-{5000 + i}", None, None),
        ]
        rows += [(at + k, *t) for k, t in enumerate(told)]
        at += len(told)
    df = spark.createDataFrame(rows, "doc_id int, text string, kind string, value string")
    model = fit_span_model(df)
    assert abs(model.weights["context"]) > 0.2 and model.reliability["context"] > 0.5
    wrong = []
    for r in find_pii(df, model=model).collect():
        loose = [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["pii"] if not s["base"]]
        if loose != ([(r["kind"], r["value"])] if r["kind"] else []):
            wrong.append((r["text"], loose))
    assert len(wrong) <= 0.05 * len(rows), wrong[:5]


def test_loose_spans_clear_of_base_spans(spark):
    """Against a comparison of all pairs, on texts where both kinds meet."""
    texts = [
        "call +1 (415) 555-5227 and (415) 555-5227, 4111 1111 1111 1111 or 4000 1234 5678 9010x",
        "é\U0001F600 a (at) b.de a@b.de (415) 555-5227 \U0001F600 +1 (984) 555-5227 219-09-9999",
        " ".join(f"+1 (984) 555-{i:04d} (984) 555-{i:04d} u{i} (at) h.org u@h{i}.org" for i in range(200)),
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", candidates(F.col("text")).alias("c")).collect():
        base = [(s["start"], s["end"]) for s in row["c"] if s["base"]]
        wanted = []
        for kind in ("email", "card", "phone", "ssn"):
            pattern = LOOSE[kind].replace("(?i)", "")
            for m in re.finditer(pattern, row["text"], re.I if kind == "email" else 0):
                if not any(a < m.end() and m.start() < b for a, b in base):
                    wanted.append((kind, m.start(), m.end()))
        assert [(s["kind"], s["start"], s["end"]) for s in row["c"] if not s["base"]] == wanted


def test_dense_long_text(spark):
    """A megabyte of spans, strict and loose, in one text."""
    part = "u{0}@h{0}.org (415) 555-{1:04d} 10.0.0.{2} 219-09-{1:04d} "
    text = "".join(part.format(i, i % 10_000, i % 256) for i in range(19_000))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    begin = time.perf_counter()
    found = find_pii(df, keep_text=False).first()["pii"]
    assert time.perf_counter() - begin < 40
    assert sum(s["base"] for s in found) == 38_000 and len(found) >= 38_000


def test_masks_replace_overlaps_once(spark):
    spans = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    rows = [
        (1, "héllo a@b.c and 1.2.3.4!", [("ip", 16, 23, True), ("email", 6, 11, True)]),
        (2, "x 0123456789 y", [("card", 2, 8, True), ("phone", 5, 12, True)]),
        (3, "none", []),
        (4, None, []),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, text string, pii {spans}")
    assert [r["text"] for r in mask_pii(df).orderBy("doc_id").collect()] == [
        "héllo [EMAIL] and [IP]!", "x [CARD] y", "none", None,
    ]


@pytest.mark.parametrize("rows", [[], [(None, None, "z")], [(1, "a@b.de", "z"), (1, "a@b.de", "z")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string, pii string")
    out = find_pii(df)
    assert out.columns == ["doc_id", "text", "pii"] and out.count() == len(rows)
    assert mask_pii(out).select(F.count("*")).first()[0] == len(rows)
