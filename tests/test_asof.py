"""The last row carried forward, against a plain search."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from metricweave.operators import asof
from metricweave.operators.asof import join_latest
from metricweave.session import store

LEFT, RIGHT = "host string, time long, x int", "host string, time long, y int, z string"


def plain(left, right, tolerance=None, how="left"):
    out = []
    for host, time, x in left:
        known = [r for r in right if r[0] is not None and r[1] is not None and time is not None and r[0] == host and r[1] <= time]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")) if known else None
        if best and tolerance is not None and best[1] < time - tolerance:
            best = None
        if best or how == "left":
            out.append((host, time, x, *(best[2:] if best else (None, None)), best[1] if best else None))
    return sorted(out, key=repr)


def met(spark, left, right, **options):
    got = join_latest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), right_time="seen", **options)
    assert got.columns == ["host", "time", "x", "y", "z", "seen"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


HOSTS, TIMES = st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 12))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(HOSTS, TIMES, st.integers(0, 2)), max_size=12),
    st.lists(st.tuples(HOSTS, TIMES, st.one_of(st.none(), st.integers(0, 2)), st.sampled_from([None, "p", "q"])), max_size=12),
    st.sampled_from([None, 0, 3]),
    st.sampled_from(["left", "inner"]),
)
def test_against_a_plain_search(spark, left, right, tolerance, how):
    assert met(spark, left, right, tolerance=tolerance, how=how) == plain(left, right, tolerance, how)


def test_one_hot_host_lies_in_several_partitions(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(asof, "store", lambda df, label: kept.append(store(df, label)) or kept[-1])
    rng = random.Random(4)
    left = [("hot", rng.randrange(100_000), i) for i in range(4000)]
    right = [("hot", rng.randrange(100_000), i, None) for i in range(300)] + [("hot", 5, 1, "only early")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert met(spark, left, right) == plain(left, right)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 4300 / 2


def test_a_value_is_carried_over_many_partitions(spark):
    left = spark.range(8000).select(F.lit("h").alias("host"), (F.col("id") + 10).alias("time"))
    right = spark.createDataFrame([("h", 9, 77)], "host string, time long, y int")
    got = join_latest(left, right)
    assert got.where("y = 77").count() == 8000
    assert join_latest(left, right, tolerance=100, how="inner").count() == 100


def test_equal_rows_and_other_keys(spark):
    left = spark.createDataFrame([(1, 2, 5), (1, 2, 5), (1, 3, 5)], "a int, b int, at int")
    right = spark.createDataFrame([(1, 2, 5, "v"), (1, 3, 6, "w")], "a int, b int, at int, y string")
    got = join_latest(left, right, by=["a", "b"], time="at")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2, 5, "v"), (1, 2, 5, "v"), (1, 3, 5, None)]
    assert join_latest(left.limit(0), right, by=["a", "b"], time="at").count() == 0
    with pytest.raises(ValueError):
        join_latest(left, right, by=["a", "b"], time="at", how="outer")
