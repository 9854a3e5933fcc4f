"""Projection, joins and the unified table on feed-shaped fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from metricweave.functions.ids import app_id_number
from metricweave.functions.times import UNIT_NS
from metricweave.operators.grouping import column_std, group_series, row_count
from metricweave.operators.joins import align_feed, join_jobs, join_metrics, join_optional, union_series
from metricweave.operators.projection import (
    fill_missing,
    flatten_unified,
    positions,
    project_positions,
    rekey,
    split_label,
    with_key,
)
from metricweave.plans.unify import FEATURES, unify, unify_series
from metricweave.schemas import SPARK_DRIVER
from metricweave.sources.series import feed_rows, read_series_json

CONTAINER = "ContainerResource_container_e17_1489_%s_01_%s"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_positions():
    assert positions([(1, 3), 7, (0, 1)]) == [1, 2, 7, 0]


def test_project_positions(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "id int, values array<string>")
    got = project_positions(df, [2, (0, 1), (5, 6)], names={0: "first"})
    assert got.columns == ["id", "_c2", "first", "_c5"]
    assert rows(got) == [(1, "c", "a", None), (2, None, "d", None)]


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a double, b string, c int, d boolean")
    assert rows(fill_missing(df)) == [(-1.0, "-1", -1, None)]
    assert rows(fill_missing(df, 0, ["a"])) == [(0.0, None, None, None)]


def test_key_and_label(spark):
    df = spark.createDataFrame([("x", 5, "h", 2.9)], "app_id string, t long, node string, y double")
    keyed = with_key(df, "t", "node")
    assert keyed.columns == ["time", "host", "app_id", "y"]
    assert rekey(keyed, "app_id").columns == ["app_id", "time", "host", "y"]
    assert flatten_unified(keyed).columns == ["time", "app_id", "y"]
    assert rows(split_label(flatten_unified(keyed), "y")) == [(5, "x", 2)]


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a", 10), (1, "a", 11), (2, "a", 12), (3, "b", 13), (None, "b", 14)],
                                 "time long, host string, x int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (3, "b", 3.0), (9, "z", 4.0), (None, "b", 5.0)],
                                 "time long, host string, y double")


INNER = [(1, "a", 10, 1.0), (1, "a", 10, 2.0), (1, "a", 11, 1.0), (1, "a", 11, 2.0), (3, "b", 13, 3.0)]
UNMATCHED = [(2, "a", 12, None), (None, "b", 14, None)]


@pytest.mark.parametrize("salts", [None, 1, 4])
def test_join_multiplies_repeated_keys(left, right, salts):
    assert rows(join_metrics(left, right, salts=salts)) == sorted(INNER, key=repr)
    assert rows(join_metrics(left, right, how="left", salts=salts)) == sorted(INNER + UNMATCHED, key=repr)


def test_join_type_is_checked(left, right):
    with pytest.raises(ValueError):
        join_metrics(left, right, how="full")


def test_optional_source(left, right):
    empty = right.where("false")
    assert {r["y"] for r in join_optional(left, empty).collect()} == {0.0}
    assert rows(join_optional(left, right)) == sorted(INNER + [(*r[:3], 0.0) for r in UNMATCHED], key=repr)


def test_salting_spreads_one_hot_key_after_a_join(spark):
    """The left side lies in one partition per key, as an earlier join on the key leaves it."""
    big = spark.range(20_000).select(F.lit(1).alias("time"), F.lit("h").alias("host"), "id")
    big = big.repartition(4, "time", "host")
    small = spark.createDataFrame([(1, "h", 0.5)], "time int, host string, y double")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        joined = join_metrics(big, small, salts=16)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.select("id").distinct().count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and len(sizes) == 4 and max(sizes) <= 20_000 / 2


def test_jobs(spark):
    df = spark.createDataFrame([("a1", 1), ("a2", 2), ("a3", 3)], "app_id string, x int")
    jobs = spark.createDataFrame([("a1", 7), ("a1", 8), ("a2", 9)], "app_id string, job_value int")
    assert rows(join_jobs(df, jobs)) == [("a1", 1, 7), ("a1", 1, 8), ("a2", 2, 9)]


def test_align(spark):
    s = UNIT_NS["s"]
    df = spark.createDataFrame([(1, "h", 1.0), (s - 1, "h", 3.0), (s, "h", 5.0), (s, "g", 7.0)], "time long, host string, x double")
    assert rows(align_feed(df, s, {"x": "avg"})) == [(0, "h", 2.0), (s, "g", 7.0), (s, "h", 5.0)]


def test_union_keeps_repeats(left):
    assert union_series([left, left, left.select("x", "host", "time")]).count() == 15
    assert union_series([left]).count() == 5


def test_grouping(spark):
    df = spark.createDataFrame([(1, "a", "p", 1.0), (2, "a", "p", 3.0), (2, "b", None, 5.0)], "time int, cpu string, source string, x double")
    assert rows(group_series(df, ["^c", "our"])) == [("a", "p", 2), ("b", None, 1)]
    assert rows(group_series(df, ["time"], [F.sum("x").alias("x")])) == [(1, 1.0), (2, 8.0)]
    assert rows(row_count(df)) == [(3,)]
    assert rows(column_std(df, ["x"], ["cpu"])) == [("a", 1.0), ("b", 0.0)]


@pytest.fixture(scope="module")
def feeds(spark):
    cpu = spark.createDataFrame([(1, "n1", 0.1, None, 0.3), (2, "n1", 0.4, 0.5, 0.6)],
                                "time long, host string, cpu_8 double, cpu_13 double, cpu_14 double")
    mem = spark.createDataFrame([(1, "n1", 1.0, 2.0, 3.0), (2, "n1", 4.0, 5.0, 6.0), (2, "n2", 7.0, 8.0, 9.0)],
                                "time long, host string, mem_2 double, mem_7 double, mem_12 double")
    nm = spark.createDataFrame(
        [
            (1, "Hostname=n1", 10.0, 20.9, None, 40.0, CONTAINER % ("0012", "000002")),
            (1, "Hostname=n1", 11.0, 21.9, 31.0, 41.0, CONTAINER % ("0012", "000003")),
            (2, "Hostname=n1", 12.0, 22.9, 32.0, 42.0, CONTAINER % ("0099", "000001")),
            (2, "Hostname=n1", 13.0, -3.7, 33.0, 43.0, "JvmMetrics"),
            (2, "Hostname=n1", 14.0, None, 34.0, 44.0, CONTAINER % ("0012", "000004")),
        ],
        "time long, host string, nm_39 double, nm_44 double, nm_51 double, nm_58 double, nm_100 string",
    )
    jobs = spark.createDataFrame([("application_1489_0012", 500)], "app_id string, job_value long")
    return cpu, mem, nm, jobs


def test_unify(feeds):
    got = unify(*feeds)
    assert got.columns == ["time", *FEATURES, "label"]
    assert rows(got) == [
        (1, 0.1, -1.0, 0.3, 1.0, 2.0, 3.0, 10.0, -1.0, 40.0, 17148900120100_0002.0, 14890012.0, 500, 20),
        (1, 0.1, -1.0, 0.3, 1.0, 2.0, 3.0, 11.0, 31.0, 41.0, 17148900120100_0003.0, 14890012.0, 500, 21),
        (2, 0.4, 0.5, 0.6, 4.0, 5.0, 6.0, 14.0, 34.0, 44.0, 17148900120100_0004.0, 14890012.0, 500, -1),
    ]


def test_unify_partitions_hosts_once(spark, feeds):
    """With sort-merge joins both host joins use one partitioning of their left side."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = unify(*feeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # cpu, mem, nm on (time, host); the joined rows and the jobs on application
    assert plan.count("Exchange hashpartitioning(time") == 3
    assert plan.count("Exchange hashpartitioning(app_id") == 2
    assert "Python" not in plan


def test_unify_from_query_results(spark, tmp_path, feeds):
    """Positional rows of all three measurements, as the database exports them."""
    def positional(width, cells):
        return [cells.get(i) for i in range(width)]

    series = {
        "cpu": [positional(15, {0: r[0], 1: "cpu-total", 3: r[1], 8: r[2], 13: r[3], 14: r[4]}) for r in feeds[0].collect()],
        "mem": [positional(13, {0: r[0], 8: r[1], 2: r[2], 7: r[3], 12: r[4]}) for r in feeds[1].collect()],
        "nodemanager": [
            positional(103, {0: r[0], 97: r[1], 39: r[2], 44: r[3], 51: r[4], 58: r[5], 100: r[6]})
            for r in feeds[2].collect()
        ],
    }
    lines = [
        json.dumps({"results": [{"series": [{"name": name, "columns": [], "values": [row]} for row in rows_]}]})
        for name, rows_ in series.items()
    ]
    (tmp_path / "results.json").write_text("\n".join(lines))
    points = read_series_json(spark, str(tmp_path / "results.json"))
    assert rows(unify_series(points, feeds[3])) == rows(unify(*feeds))


def test_driver_feed(spark):
    row = [str(i) for i in range(63)]
    row[5] = "application_1489_0012"
    points = spark.createDataFrame([("spark", row)], "name string, values array<string>")
    got = feed_rows(points, "spark", SPARK_DRIVER).withColumn("app_number", app_id_number(F.col("host"))).first()
    assert got["time"] == 0 and got["app_number"] == 14890012.0
    assert [got[f"spark_{p}"] for p in (8, 17, 27, 29, 52, 56, 58, 62)] == [8.0, 17.0, 27.0, 29.0, 52.0, 56.0, 58.0, 62.0]
