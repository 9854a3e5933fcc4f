"""Readers, writers and measurement scans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from metricweave.operators.grouping import group_series
from metricweave.schemas import CPU, MEM, NODE_MANAGER, SPARK_DRIVER, Feed
from metricweave.session import scratch_path, shared_dir
from metricweave.sources.csv import read_labelled_csv, read_rows_csv, write_rows_csv
from metricweave.sources.jdbc import jdbc_options, job_history, read_table_jdbc
from metricweave.sources.series import (
    feed_rows,
    points_to_rows,
    read_points_json,
    read_series_json,
    scan_measurement,
    scan_measurements,
)


def write_lines(path, *objects):
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


def result(name, values, tags=None):
    series = {"name": name, "columns": ["time", "x", "y"], "values": values}
    return {"results": [{"series": [series | ({"tags": tags} if tags else {})]}]}


def test_series_results(spark, tmp_path):
    path = write_lines(
        tmp_path / "r.json",
        result("cpu", [[1611111111000000001, "a", 1.5], [2, None, None]], {"source": "s"}),
        result("mem", [[3, "b", 2]]),
        {"results": [{"series": []}]},
        {"results": []},
    )
    rows = read_series_json(spark, path).collect()
    assert [r["values"] for r in rows if r["name"] == "cpu"] == [["1611111111000000001", "a", "1.5"], ["2", None, None]]
    assert [r["tags"] for r in rows] == [{"source": "s"}, {"source": "s"}, None]
    assert rows[2]["columns"] == ["time", "x", "y"]


def test_feed_columns_and_short_rows(spark, tmp_path):
    wide = [7, "cpu-total", "dc", "node7", *[float(i) for i in range(4, 15)]]
    path = write_lines(tmp_path / "r.json", result("cpu", [wide, wide[:14], [8, "cpu-total"], [9, "cpu0"]]))
    full, short, bare = (r.asDict() for r in feed_rows(read_series_json(spark, path), "cpu", CPU).collect())
    assert full == {"time": 7, "host": "node7", "cpu_8": 8.0, "cpu_13": 13.0, "cpu_14": 14.0}
    assert short == full | {"cpu_14": None}
    assert bare == {"time": 8, "host": None, "cpu_8": None, "cpu_13": None, "cpu_14": None}


def test_feed_names():
    assert MEM.metric_names() == ["mem_2", "mem_7", "mem_12"]
    assert NODE_MANAGER.metric_names() + NODE_MANAGER.label_names() == ["nm_39", "nm_44", "nm_51", "nm_58", "nm_100"]
    assert len(SPARK_DRIVER.metric_names()) == 14
    assert Feed("x", 0, 1, (2,)).label_names() == []


def test_points(spark, tmp_path):
    path = write_lines(
        tmp_path / "p.json",
        {"measurement": "disk_queue", "tags": {"host": "rack3-n7", "zone": "b"},
         "time": "2021-03-04T05:06:07.123456789Z", "fields": {"depth": 1.25, "waits": 3, "status": "ok"}},
        {"measurement": "disk_queue", "tags": {}, "time": "2021-03-04T05:06:07Z", "fields": {"depth": 0}},
    )
    rows = points_to_rows(read_points_json(spark, path)).orderBy("time_ns", "field").collect()
    assert [(r["field"], r["value"], r["text"]) for r in rows] == [
        ("depth", 0.0, None), ("depth", 1.25, None), ("status", None, "ok"), ("waits", 3.0, None)]
    assert [r["time_ns"] - 1614834367 * 10**9 for r in rows] == [0, 123456789, 123456789, 123456789]
    assert rows[1]["time"].isoformat() == "2021-03-04T05:06:07.123456" and rows[1]["tags"]["host"] == "rack3-n7"


@pytest.mark.parametrize("line, options, said", [
    ('{"results":[{"series":[{"name":"a","columns":[],"val', {}, "Malformed"),
    ('{"results":[{"error":"no such measurement"}]}', {}, "no such measurement"),
    ('{"error":"timeout"}', {"allow_partial": True}, "timeout"),
    ('{"results":[{"series":[{"name":"a","columns":[],"values":[["1"]],"partial":true}]}]}', {}, "cut short"),
])
def test_bad_results_stop_the_read(spark, tmp_path, line, options, said):
    good = '{"results":[{"series":[{"name":"a","columns":[],"values":[["1"]]}]}]}'
    (tmp_path / "r.json").write_text(f"{good}\n{line}\n")
    with pytest.raises(Exception, match=f"(?i){said}"):
        read_series_json(spark, str(tmp_path / "r.json"), **options).collect()


def test_pretty_and_partial_results(spark, tmp_path):
    whole = {"results": [{"series": [{"name": "a", "columns": ["time"], "values": [[1], [2]], "partial": True}]}]}
    (tmp_path / "r.json").write_text(json.dumps(whole, indent=2))
    rows = read_series_json(spark, str(tmp_path / "r.json"), pretty=True, allow_partial=True).collect()
    assert [r["values"] for r in rows] == [["1"], ["2"]]


def test_labels_from_the_tags_map(spark, tmp_path):
    wide = [7, "cpu-total", "dc", "node7", *[float(i) for i in range(4, 15)]]
    path = write_lines(tmp_path / "r.json", result("cpu", [wide, ["8", "cpu0"]], {"source": "s", "rack": "r"}))
    points = read_series_json(spark, path)
    assert [(r["time"], r["source"]) for r in feed_rows(points, "cpu", CPU, tags=["source"]).collect()] == [(7, "s")]
    assert [tuple(r) for r in group_series(points, ["^rac", "^name$"], tags="tags").collect()] == [("cpu", "r", 2)]
    many = points.select(F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: i.cast("string")), F.sequence(F.lit(1), F.lit(600))).alias("tags"))
    with pytest.raises(ValueError):
        group_series(many, ["."], tags="tags")


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('"say ""hi"", x",2,3\n')
    assert [tuple(r) for r in read_rows_csv(spark, str(tmp_path / "rows.csv"), 3).collect()] == [('say "hi", x', "2", "3")]


@pytest.mark.parametrize("text", ["1,2,3,4\n", "1,2\n"])
def test_rows_of_another_width_stop_the_read(spark, tmp_path, text):
    (tmp_path / "rows.csv").write_text("a,b,c\n" + text)
    with pytest.raises(Exception):
        read_rows_csv(spark, str(tmp_path / "rows.csv"), 3).select("_c0").collect()


def test_dirty_labelled_cells_stop_the_read(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("120,4\n6.4,x\n")
    with pytest.raises(Exception):
        read_labelled_csv(spark, str(tmp_path / "rows.csv"), ["length"], "target").collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1.48E16", 2, None), ("a,b", 3, 'q"')], "a string, b int, c string")
    write_rows_csv(df, str(tmp_path / "rows"))
    back = read_rows_csv(spark, str(tmp_path / "rows"), 3)
    assert back.columns == ["_c0", "_c1", "_c2"]
    assert {tuple(r) for r in back.collect()} == {("1.48E16", "2", None), ("a,b", "3", 'q"')}


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("120,4,setosa,versicolor\n6.4,2\n5.0,1\n")
    rows = read_labelled_csv(spark, str(tmp_path / "iris.csv"), ["length"], "target").collect()
    assert [(round(r["length"], 3), r["target"]) for r in rows] == [(6.4, 2), (5.0, 1)]


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "jobs_history", user="u") == {
        "url": "jdbc:x", "dbtable": "jobs_history", "fetchsize": "10000", "user": "u"}
    split = jdbc_options("jdbc:x", "jobs_history", "id", (0, 100), 4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "4")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "jobs_history", "id")


def test_whole_table_scans_must_be_asked_for(spark):
    with pytest.raises(ValueError, match="one_task"):
        read_table_jdbc(spark, "jdbc:x", "jobs_history")


def test_scans_are_pushed(spark, sf_dir):
    from metricweave.catalog import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = plan("scan_measurement")
    assert "GreaterThan(ts," in scan and "LessThan(ts," in scan and "EqualTo(event_type,click)" in scan
    assert "StringStartsWith(event_type,cl)" in plan("latest_points")


@pytest.mark.parametrize("kind", ["bigint", "timestamp"])
@pytest.mark.parametrize("limit", [1000, 1001])
def test_limits_of_any_size_on_any_time(spark, kind, limit):
    df = spark.range(1500).select(F.col("id").cast(kind).alias("time"))
    assert scan_measurement(df, newest_first=True, limit=limit).count() == limit


def test_job_history_positions(spark):
    rows = spark.createDataFrame([(42, "u", "q", "application_1_1", "extra")], "v long, a string, b string, c string, d string")
    assert [r.asDict() for r in job_history(rows).collect()] == [{"app_id": "application_1_1", "job_value": 42}]


@pytest.fixture(scope="module")
def stored(spark):
    rows = [("cpu", t, "cpu-total" if t % 2 else "cpu0", float(t)) for t in range(10)] + [("mem", 5, None, 1.0)]
    return spark.createDataFrame(rows, "measurement string, time long, cpu string, x double")


def test_scan_measurement(stored):
    got = scan_measurement(stored, "cpu", {"cpu": "cpu-total"}, after=1, before=9, newest_first=True, limit=2)
    assert [r["time"] for r in got.collect()] == [7, 5]
    assert [r["time"] for r in scan_measurement(stored, "cpu", limit=3).collect()] == [0, 1, 2]
    assert scan_measurement(stored, "none").count() == 0


@pytest.mark.parametrize("rows, limit", [(5000, 1200), (5000, 4999), (1300, 1300), (1300, 2000)])
def test_large_newest_limit(spark, rows, limit):
    hour = 3_600_000_000_000
    # 700 points an hour, and ten without a time
    stored = spark.range(rows).select("id", (F.col("id") * (hour // 700)).alias("time")).union(
        spark.range(10).select(F.col("id") - 10, F.lit(None).cast("long")))
    got = [r["id"] for r in scan_measurement(stored, newest_first=True, limit=limit, ties=["id"]).collect()]
    assert got[: min(rows, limit)] == list(range(rows - 1, max(rows - limit, 0) - 1, -1))
    assert len(got) == min(limit, rows + 10)


def test_scan_prunes_a_partitioned_table(spark, stored):
    path = scratch_path(spark, "stored")
    stored.write.partitionBy("measurement").parquet(path)
    scan = scan_measurement(spark.read.parquet(path), "cpu", after=3).select("x")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(measurement" in plan
    assert "GreaterThan(time,3)" in plan and "ReadSchema: struct<time:bigint,x:double>" in plan


def test_scan_measurements(stored):
    got = scan_measurements(stored, patterns=["^c"], exact=["mem"], per_series_limit=3).collect()
    assert sorted((r["measurement"], r["time"]) for r in got) == [("cpu", 0), ("cpu", 1), ("cpu", 2), ("mem", 5)]
    assert scan_measurements(stored).count() == 0


def test_series_limit_runs_before_the_shuffle(stored):
    plan = scan_measurements(stored, ["c"], per_series_limit=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_scratch_paths_share_the_checkpoint_folder(spark):
    one, two = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert one != two and one.startswith(shared_dir(spark).rstrip("/"))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured
