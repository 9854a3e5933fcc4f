"""Live sources: results dropped into a folder, and the unified table from streams."""

from __future__ import annotations

import json
import os

import pytest

from metricweave.plans.unify import unify
from metricweave.session import scratch_path
from metricweave.sources.series import read_series_json
from metricweave.streaming.deadman import _close_slots
from metricweave.streaming.series import BAD_LINE, rejected_lines, series_stream, store_series, stored_points
from metricweave.streaming.unify import unify_stream

GOOD = {"results": [{"series": [{"name": "cpu", "tags": {"r": "1"}, "columns": ["time", "v"], "values": [[1, 2.5], [2, None]]}]}]}
EMPTY = {"results": [{"series": [{"name": "cpu", "columns": ["time"]}]}, {}]}
CUT = {"results": [{"partial": True, "series": [{"name": "mem", "values": [[1]]}]}]}


class Folder:
    def __init__(self, spark):
        self.spark, self.path, self.out = spark, scratch_path(spark, "results"), scratch_path(spark, "live")
        os.makedirs(self.path.removeprefix("file:"), exist_ok=True)
        self.number = 0

    def drop(self, *lines):
        self.number += 1
        with open(f"{self.path.removeprefix('file:')}/{self.number}.json", "w") as f:
            f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")

    def run(self, **options):
        store_series(series_stream(self.spark, self.path, **options), f"{self.out}/rows", f"{self.out}/progress").awaitTermination()

    def points(self):
        return sorted(((r["name"], r["values"]) for r in stored_points(self.spark, f"{self.out}/rows").collect()), key=repr)

    def rejected(self):
        return sorted(tuple(r) for r in rejected_lines(self.spark, f"{self.out}/rows").collect())


def test_bad_results_are_set_aside_and_the_stream_goes_on(spark):
    folder = Folder(spark)
    folder.drop(GOOD, "", '{"results": [', {"error": "timeout"}, EMPTY, CUT, {"results": [{"error": "no such db"}]}, "[1]", "7")
    folder.run()
    assert folder.points() == [("cpu", ["1", "2.5"]), ("cpu", ["2", None])]
    assert folder.rejected() == sorted([
        ('{"results": [', BAD_LINE), ("[1]", BAD_LINE), ("7", BAD_LINE),
        ('{"error": "timeout"}', "query result with an error: timeout"),
        (json.dumps(CUT), "query result was cut short"),
        (json.dumps({"results": [{"error": "no such db"}]}), "query result with an error: no such db"),
    ])


def test_restart_goes_on_where_it_stopped(spark):
    folder = Folder(spark)
    folder.drop(GOOD)
    folder.drop({"error": "first"})
    folder.run(files_per_batch=1)
    assert len(folder.points()) == 2 and len(folder.rejected()) == 1
    folder.run()
    assert len(folder.points()) == 2
    folder.drop(GOOD, CUT)
    folder.run(allow_partial=True)
    assert len(folder.points()) == 5 and len(folder.rejected()) == 1


def test_only_rejected_lines_and_only_empty_ones(spark):
    folder = Folder(spark)
    folder.drop("", " ")
    folder.run()
    assert folder.points() == [] == folder.rejected()
    folder.drop("no json")
    folder.run()
    assert folder.points() == [] and folder.rejected() == [("no json", BAD_LINE)]


def test_same_points_as_the_stored_read(spark):
    folder = Folder(spark)
    folder.drop(GOOD, GOOD, EMPTY)
    folder.drop(GOOD)
    folder.run()
    told = read_series_json(spark, folder.path).collect()
    assert folder.points() == sorted(((r["name"], r["values"]) for r in told), key=repr) and len(told) == 6


CPU = "time long, host string, cpu_8 double, cpu_13 double, cpu_14 double"
MEM = "time long, host string, mem_2 double, mem_7 double, mem_12 double"
NM = "time long, host string, nm_39 double, nm_44 double, nm_51 double, nm_58 double, nm_100 string"
NAME = "ContainerResource_container_e17_1704067200000_0011_01_000002"
S = 1_000_000_000


class Feeds:
    """Three folders of files read as streams, and the unified rows they give."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.paths = {name: scratch_path(spark, name) for name in ("cpu", "mem", "nm")}
        self.out = scratch_path(spark, "unified")
        self.sent = {name: [] for name in self.paths}
        self.jobs = spark.createDataFrame([("application_1704067200000_0011", 9.5)], "app_id string, job_value double")

    def frames(self, of):
        return [of(name, schema) for name, schema in (("cpu", CPU), ("mem", MEM), ("nm", NM))]

    def send(self, cpu=(), mem=(), nm=()):
        wide = {"cpu": (1.0, 2.0, None), "mem": (1.0, 2.0, 3.0), "nm": (1.0, 7.0, 3.0, 4.0, NAME)}
        for name, seconds in (("cpu", cpu), ("mem", mem), ("nm", nm)):
            prefix = "Hostname=" if name == "nm" else ""
            rows = [(None if s is None else s * S, f"{prefix}h", *wide[name]) for s in seconds]
            self.sent[name] += rows
            schema = {"cpu": CPU, "mem": MEM, "nm": NM}[name]
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.paths[name])
        live = self.frames(lambda name, schema: self.spark.readStream.schema(schema).parquet(self.paths[name]))
        run = (
            unify_stream(*live, self.jobs, **self.options).writeStream.format("parquet").outputMode("append")
            .trigger(availableNow=True).option("checkpointLocation", f"{self.out}/progress").option("path", f"{self.out}/rows").start()
        )
        run.awaitTermination()
        self.state_rows = sum(s["numRowsTotal"] for s in run.lastProgress["stateOperators"]) if run.lastProgress else None

    def seconds(self):
        return sorted(r["time"] // S for r in self.spark.read.parquet(f"{self.out}/rows").collect())


def test_live_feeds_give_the_stored_rows(spark):
    feeds = Feeds(spark, delay="1 hour")
    feeds.send([1, 2, 3, None], [2, 3, None], [3, 2])
    feeds.send([4], [1], [4, 1])
    feeds.send([], [4], [])
    stored = unify(*feeds.frames(lambda name, schema: spark.createDataFrame(feeds.sent[name], schema)), feeds.jobs)
    live = spark.read.parquet(f"{feeds.out}/rows").select(stored.columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, stored.collect()))
    assert feeds.seconds() == [1, 2, 3, 4]


def test_late_rows_are_left_out_and_state_is_dropped(spark):
    feeds = Feeds(spark, delay="10 seconds")
    feeds.send([1, 2, 100], [1, 100], [1, 100])
    # the watermark now stands at 90 seconds
    feeds.send([], [2], [2])
    feeds.send([101], [101], [101])
    assert feeds.seconds() == [1, 100, 101]
    # nothing older than the watermark is kept
    assert feeds.state_rows <= 12


def test_feeds_cut_to_a_grid(spark):
    feeds = Feeds(spark, delay="1 minute", step=5 * S)
    feeds.send([6, 16], [8, 19], [9, 17])
    assert feeds.seconds() == [5, 15]


class State:
    """What the group's function sees of its state."""

    def __init__(self, watermark, value):
        self.exists, self.get, self.watermark = value is not None, value, watermark

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        self.timer = at


@pytest.mark.parametrize("changes_only", [False, True])
def test_a_year_of_silence_is_one_step(changes_only):
    step, year = 10_000_000, 365 * 86_400
    state = State(year * 1000, (step, "OK", [5 * step], [3]))
    frames = list(_close_slots(["host"], step, 0.0, changes_only)(("a",), iter(()), state))
    got = [tuple(r) for r in frames[0].itertuples(index=False)]
    end = year * 1_000_000
    silent = (5 - 1) * step
    if changes_only:
        assert got == [("a", step, step, 0, "CRITICAL"), ("a", 5 * step, 5 * step, 3, "OK"), ("a", 6 * step, 6 * step, 0, "CRITICAL")]
    else:
        assert got == [("a", step, silent, 0, "CRITICAL"), ("a", 5 * step, 5 * step, 3, "OK"), ("a", 6 * step, end - step, 0, "CRITICAL")]
    assert state.get == (end, "CRITICAL", [], []) and state.timer == (end + step) // 1000
