"""Identifiers, numbers, times and metric names."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metricweave.functions import ids
from metricweave.functions.numeric import clamp_allocation, int_label, relu, sigmoid
from metricweave.functions.paths import metric_path
from metricweave.functions.predicates import tag_matches, time_between
from metricweave.functions.times import epoch_to_timestamp, floor_to, timestamp_to_epoch


def values(spark, kind, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_application_of_a_container(spark):
    names = [
        "ContainerResource_container_e21_1512000777123_0045_01_000002",
        "container_e21_1512000777123_0045_01_000002",
        "container_1512000777123_0045_01_000002",
        "JvmMetrics",
        "container_e21_1512000777123",
        None,
    ]
    got = values(spark, "string", names, ids.app_id_from_container)
    assert got == ["application_1512000777123_0045"] * 3 + [None] * 3


def test_numbers_of_ids(spark):
    near = ["application_1512000777123_0044", "application_1512000777123_0045", "application_x", None]
    doubles = values(spark, "string", near, ids.app_id_number)
    exact = values(spark, "string", near, lambda c: ids.app_id_number(c, exact=True))
    # beyond 2^53 neighbours share a double, so the exact form exists
    assert doubles[0] == float("15120007771230044") and doubles[2:] == [None, None]
    assert [int(v) for v in exact[:2]] == [15120007771230044, 15120007771230045] and exact[2:] == [None, None]
    containers = [f"ContainerResource_container_e21_1512000777123_0045_01_00000{i}" for i in (1, 2)]
    assert len(set(values(spark, "string", containers, ids.container_id_number))) == 1
    assert len(set(values(spark, "string", containers, lambda c: ids.container_id_number(c, exact=True)))) == 2


def test_host_prefix(spark):
    assert values(spark, "string", ["Hostname=node7", "node7", None], ids.strip_host_prefix) == ["node7", "node7", None]


def test_activations_keep_missing_values(spark):
    assert values(spark, "double", [-2.0, 0.0, 3.5, None], relu) == [0.0, 0.0, 3.5, None]
    assert math.isnan(values(spark, "double", [math.nan], relu)[0])
    got = values(spark, "double", [0.0, 2.0, -800.0, None], sigmoid)
    assert got[0] == 0.5 and got[1] == pytest.approx(0.8807970779) and got[2] == 0.0 and got[3] is None


def test_allocation_limits(spark):
    asked = [50.0, 128.0, 1000.0, 9000.0, None]
    got = values(spark, "double", asked, lambda c: clamp_allocation(c, c))
    assert [g["memory_mb"] for g in got] == [128.0, 128.0, 1000.0, 2500.0, None]
    assert [g["vcores"] for g in got] == [4.0, 4.0, 4.0, 4.0, None]
    custom = values(spark, "double", [0.0, 20.0], lambda c: clamp_allocation(c, c, vcore_limits=(2, 8)))
    assert [g["vcores"] for g in custom] == [2.0, 8.0]


def test_labels_truncate_toward_zero(spark):
    assert values(spark, "double", [2.9, -2.9, None, 1e300], int_label) == [2, -2, None, None]
    assert values(spark, "string", ["7.8", "1.5E2", "n/a"], int_label) == [7, 150, None]


@pytest.mark.parametrize("unit, epoch", [
    ("ns", 1499704325000000999), ("u", 1499704325000000), ("ms", 1499704325000), ("s", 1499704325),
])
def test_epoch_units(spark, unit, epoch):
    ts = values(spark, "bigint", [epoch], lambda c: epoch_to_timestamp(c, unit).cast("string"))
    assert ts == ["2017-07-10 16:32:05"]
    back = values(spark, "bigint", [epoch], lambda c: timestamp_to_epoch(epoch_to_timestamp(c, unit), unit))
    assert back == [epoch // 1000 * 1000 if unit == "ns" else epoch]


def test_coarse_units_and_negative_epochs(spark):
    assert values(spark, "bigint", [2], lambda c: epoch_to_timestamp(c, "h").cast("string")) == ["1970-01-01 02:00:00"]
    assert values(spark, "bigint", [-1], lambda c: timestamp_to_epoch(epoch_to_timestamp(c, "ns"))) == [-1000]
    assert values(spark, "bigint", [-1, 0, 9, 10], lambda c: floor_to(c, 10)) == [-10, 0, 0, 10]


def test_time_bounds_are_exclusive(spark):
    assert values(spark, "int", [1, 2, 3, 4], lambda c: time_between(c, 1, 4)) == [False, True, True, False]
    assert values(spark, "int", [1, 4], lambda c: time_between(c)) == [True, True]
    recent = lambda c: time_between(c, after=F.current_timestamp() - F.expr("interval 4 hours"))
    assert values(spark, "timestamp", [datetime(2000, 1, 1)], recent) == [False]


def test_patterns_are_found_anywhere(spark):
    names = ["cpu-total", "cpu0", "x cpu-total y", None]
    assert values(spark, "string", names, lambda c: tag_matches(c, "cpu-total")) == [True, False, True, None]
    assert values(spark, "string", ["container_1", "a.jvm"], lambda c: tag_matches(c, "container.*$", "1")) == [True, False]


def test_metric_names(spark):
    names = [
        "nodemanager.jvm.JvmMetrics.Context=jvm.ProcessName=NodeManager.Hostname=vagrant.MemHeapUsedM",
        "plain",
        "a.k=1.k=2.leaf",
        "a.empty=.leaf",
    ]
    got = values(spark, "string", names, metric_path)
    assert got[0]["prefix"] == "nodemanager.jvm.JvmMetrics" and got[0]["leaf"] == "MemHeapUsedM"
    assert got[0]["tags"] == {"Context": "jvm", "ProcessName": "NodeManager", "Hostname": "vagrant"}
    assert (got[1]["prefix"], got[1]["tags"], got[1]["leaf"]) == ("", {}, "plain")
    assert got[2]["tags"] == {"k": "1"} and got[3]["tags"] == {"empty": ""}


def test_scratch_folder_is_one_that_executors_share():
    from metricweave.session import folder_for

    assert folder_for("file:/home/x/wh", "local[4]", "file:///") == "file:/home/x/wh/_scratch"
    assert folder_for("hdfs://n/wh", "yarn", "file:///") == "hdfs://n/wh/_scratch"
    assert folder_for("/wh", "spark://h:7077", "hdfs://n") == "/wh/_scratch"
    for warehouse, master in (("file:/wh", "yarn"), ("/wh", "spark://h:7077"), ("file:///wh", "local-cluster[2,1,1024]")):
        with pytest.raises(ValueError):
            folder_for(warehouse, master, "file:///")
