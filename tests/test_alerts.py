"""Heartbeats and level changes, stored and streamed."""

from __future__ import annotations

import itertools
import os
from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from metricweave.functions.times import UNIT_NS
from metricweave.operators import alerts
from metricweave.operators.alerts import ALIVE, DEAD, deadman, state_changes_only, with_message
from metricweave.session import scratch_path, store
from metricweave.streaming.deadman import deadman_stream, emitted_stream

S = UNIT_NS["s"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_deadman_fills_silence(spark):
    points = [("a", 1 * S), ("a", 9 * S), ("a", 31 * S), ("b", 12 * S)]
    df = spark.createDataFrame(points, "host string, time long")
    assert rows(deadman(df, ["host"])) == sorted([
        ("a", 0, 2, ALIVE), ("a", 10 * S, 0, DEAD), ("a", 20 * S, 0, DEAD), ("a", 30 * S, 1, ALIVE),
        ("b", 0, 0, DEAD), ("b", 10 * S, 1, ALIVE), ("b", 20 * S, 0, DEAD), ("b", 30 * S, 0, DEAD),
    ], key=repr)


def test_deadman_threshold_and_bounds(spark):
    df = spark.createDataFrame([("a", 5 * S), ("a", 15 * S), ("a", 16 * S), ("a", 95 * S)], "host string, time long")
    got = deadman(df, ["host"], threshold=1, start=F.lit(-10 * S), stop=F.lit(20 * S))
    assert rows(got) == sorted([
        ("a", -10 * S, 0, DEAD), ("a", 0, 1, DEAD), ("a", 10 * S, 2, ALIVE), ("a", 20 * S, 0, DEAD)], key=repr)


def test_deadman_reports_groups_silent_all_through(spark):
    df = spark.createDataFrame([("before", 5 * S), ("after", 95 * S), ("in", 45 * S), ("in", 5 * S)], "host string, time long")
    got = deadman(df, ["host"], start=F.lit(30 * S), stop=F.lit(50 * S))
    assert rows(got) == sorted(
        [(h, s * S, 0, DEAD) for h in ("before", "after") for s in (30, 40, 50)]
        + [("in", 30 * S, 0, DEAD), ("in", 40 * S, 1, ALIVE), ("in", 50 * S, 0, DEAD)], key=repr)


def test_points_without_time(spark):
    df = spark.createDataFrame([("a", None), ("a", 15 * S), ("b", None), (None, 25 * S)], "host string, time long")
    assert rows(deadman(df, ["host"])) == sorted([
        ("a", 10 * S, 1, ALIVE), ("a", 20 * S, 0, DEAD), (None, 10 * S, 0, DEAD), (None, 20 * S, 1, ALIVE)], key=repr)


def test_messages(spark):
    df = spark.createDataFrame([("n1", 7, 0, 0, DEAD), ("n2", 8, 0, 3, ALIVE)], "host string, port int, slot long, emitted long, level string")
    got = [(r["id"], r["message"]) for r in with_message(df, ["host", "port"], "beat").orderBy("host").collect()]
    assert got[0] == ("host=n1,port=7:NODE_NAME for task 'beat'",
                      "host=n1,port=7:NODE_NAME for task 'beat' is dead: 0.000 points/INTERVAL.")
    assert got[1][1].endswith("is alive: 3.000 points/INTERVAL.")


def test_deadman_of_nothing(spark):
    assert deadman(spark.createDataFrame([], "host string, time long"), ["host"]).count() == 0


@contextmanager
def shuffled(spark, partitions):
    """So many shuffle partitions, none of them merged."""
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def changes(levels):
    """(group, t, level) rows → those whose level differs from the group's row before."""
    out, last = [], {}
    for group, t, level in sorted(levels, key=lambda r: r[1]):
        if group not in last or last[group] != level:
            out.append((group, t, level))
        last[group] = level
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_state_changes(spark, parts):
    levels = [(g, t, [ALIVE, DEAD, None][(t * t + i) % 11 % 3]) for i, g in enumerate(["a", "b", None]) for t in range(i, 40)]
    df = spark.createDataFrame(levels, "g string, t int, level string").repartition(4)
    with shuffled(spark, parts):
        assert rows(state_changes_only(df, ["g"], ["t"])) == changes(levels)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([ALIVE, DEAD, None]), max_size=30), st.integers(1, 9))
def test_pieces_never_change_the_answer(spark, levels, parts):
    table = [("g", t, level) for t, level in enumerate(levels)]
    df = spark.createDataFrame(table, "g string, t int, level string")
    with shuffled(spark, parts):
        assert rows(state_changes_only(df, ["g"], ["t"])) == changes(table)


def test_one_group_is_compared_in_several_pieces(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(alerts, "store", lambda df, label: kept.append(store(df, label)) or kept[-1])
    df = spark.range(20_000).select(F.lit("g").alias("g"), "id", F.when(F.col("id") % 7 < 3, "OK").alias("level"))
    with shuffled(spark, 8):
        found = state_changes_only(df, ["g"], ["id"]).count()
    assert found == sum(1 for i in range(20_000) if i == 0 or (i % 7 < 3) != ((i - 1) % 7 < 3))
    sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000 / 4


def test_a_stray_early_time_makes_no_giant_array(spark):
    df = spark.createDataFrame([("a", 0), ("b", 100_000 * 10), ("a", 100_000 * 10)], "host string, time long")
    found = deadman(df, ["host"], interval=10)
    assert found.groupBy("host").count().collect() and found.count() == 2 * 100_001
    assert found.where("emitted > 0").count() == 3
    assert alerts.RUN <= 8640


START = datetime(2024, 1, 1)
SCHEMA = "host string, ts timestamp"


class Feed:
    """A folder of files, each read as one micro-batch."""

    def __init__(self, spark, alerts):
        self.spark, self.alerts = spark, alerts
        self.source, self.sink = scratch_path(spark, "feed"), scratch_path(spark, "alerts")
        self.clock = itertools.count(1_700_000_000)

    def send(self, *points):
        data = [(host, None if s is None else START + timedelta(seconds=s)) for host, s in points]
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        run = (
            self.alerts(self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source))
            .writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", self.sink + "/progress").option("path", self.sink + "/rows").start()
        )
        run.awaitTermination()

    def seen(self):
        out = self.spark.read.parquet(self.sink + "/rows").collect()
        return sorted((r["host"], int((r["slot"] - START).total_seconds()), *r[2:]) for r in out)


def test_silent_group_keeps_reporting(spark):
    feed = Feed(spark, lambda df: deadman_stream(df, ["host"], "ts"))
    feed.send(("a", 1), ("a", 2), ("b", 5))
    feed.send(("a", 12))
    feed.send(("a", 41))
    # the watermark stands at 41 s: slots ending by then are closed
    assert feed.seen() == [
        ("a", 0, 2, ALIVE), ("a", 10, 1, ALIVE), ("a", 20, 0, DEAD), ("a", 30, 0, DEAD),
        ("b", 0, 1, ALIVE), ("b", 10, 0, DEAD), ("b", 20, 0, DEAD), ("b", 30, 0, DEAD),
    ]
    feed.send(("b", 61))
    assert feed.seen()[-5:] == [
        ("b", 10, 0, DEAD), ("b", 20, 0, DEAD), ("b", 30, 0, DEAD), ("b", 40, 0, DEAD), ("b", 50, 0, DEAD)]
    assert ("a", 40, 1, ALIVE) in feed.seen() and ("a", 50, 0, DEAD) in feed.seen()


def test_delay_admits_earlier_points_of_a_new_group(spark):
    feed = Feed(spark, lambda df: deadman_stream(df, ["host"], "ts", delay="30 seconds"))
    feed.send(("a", 25))
    feed.send(("a", 3), ("a", 14))
    feed.send(("a", 66))
    assert feed.seen() == [("a", 0, 1, ALIVE), ("a", 10, 1, ALIVE), ("a", 20, 1, ALIVE)]


def test_long_silence_comes_in_frames(spark):
    feed = Feed(spark, lambda df: deadman_stream(df, ["host"], "ts"))
    feed.send(("a", 1))
    feed.send(("b", 600_000))
    assert [r[1] for r in feed.seen() if r[0] == "a"] == list(range(0, 600_000, 10))


def test_only_changes_are_reported(spark):
    feed = Feed(spark, lambda df: deadman_stream(df, ["host"], "ts", threshold=1, changes_only=True))
    # a point without a time counts nowhere
    feed.send(("a", 1), ("a", 2), ("a", None), ("a", 13), ("b", 1))
    feed.send(("a", 35), ("a", 36), ("a", 71))
    assert feed.seen() == [
        ("a", 0, 2, ALIVE), ("a", 10, 1, DEAD), ("a", 30, 2, ALIVE), ("a", 40, 0, DEAD), ("b", 0, 1, DEAD)]


def test_stream_agrees_with_stored_points(spark):
    points = [(h, (i * 37 + 11 * n) % 300) for n, h in enumerate("abc") for i in range(12 + n)]
    feed = Feed(spark, lambda df: deadman_stream(df, ["host"], "ts", "20 seconds"))
    feed.send(*points)
    feed.send(("a", 400))
    df = spark.createDataFrame([(h, s * S) for h, s in [*points, ("a", 400)]], "host string, time long")
    stored = deadman(df, ["host"], interval=20 * S)
    first = df.groupBy("host").agg((F.min("time") - F.min("time") % (20 * S)).alias("first"))
    closed = stored.join(first, "host").where("slot >= first and slot < 400e9").drop("first")
    assert feed.seen() == sorted((r["host"], r["slot"] // S, r["emitted"], r["level"]) for r in closed.collect())


def test_groups_of_two_columns(spark):
    def alerts(df):
        found = deadman_stream(df.withColumn("port", F.length("host")), ["host", "port"], "ts")
        return found.select(F.concat("host", F.col("port").cast("string")).alias("host"), "slot", "emitted", "level")

    feed = Feed(spark, alerts)
    feed.send(("a", 1), ("bb", 2), ("a", 21))
    assert feed.seen() == [("a1", 0, 1, ALIVE), ("a1", 10, 0, DEAD), ("bb2", 0, 1, ALIVE), ("bb2", 10, 0, DEAD)]


def test_window_counts(spark):
    feed = Feed(spark, lambda df: emitted_stream(df, ["host"], "ts"))
    feed.send(("a", 1), ("a", 2), ("b", 5), ("a", 13))
    feed.send(("b", 29))
    assert feed.seen() == [("a", 0, 2), ("a", 10, 1), ("b", 0, 1)]


def test_points_are_counted_before_the_shuffle(spark):
    path = scratch_path(spark, "plain")
    os.makedirs(path)
    alerts = deadman_stream(spark.readStream.schema(SCHEMA).parquet(path), ["host"], "ts")
    plan = alerts._jdf.queryExecution().analyzed().toString()
    assert plan.index("FlatMapGroupsInPandasWithState") < plan.index("MapInPandas")
