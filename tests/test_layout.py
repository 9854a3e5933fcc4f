"""Stored layouts: folders by name and day, and buckets by join key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from metricweave.functions.times import DAY_NS
from metricweave.plans.unify import container_rows, unify, unify_containers
from metricweave.session import scratch_path
from metricweave.sources.layout import day_of, read_measurements, scan_stored, write_bucketed, write_measurements
from metricweave.sources.series import scan_measurements


@pytest.fixture(scope="module")
def points(spark):
    names = F.element_at(F.array(*map(F.lit, ["cpu", "cpu_total", "mem", "disk/a b", "net"])), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(600).select("id", names.alias("measurement"), (F.col("id") * (DAY_NS // 100) - DAY_NS).alias("time"))


@pytest.fixture(scope="module")
def stored(spark, points):
    path = scratch_path(spark, "layout")
    write_measurements(points, path)
    return path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files the rows' scan opened, once the query has run."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and "/rows" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_days_before_and_after_the_epoch(spark):
    row = spark.range(1).select(*[day_of(F.lit(t)).alias(f"d{i}") for i, t in enumerate((-1, 0, DAY_NS - 1, DAY_NS))]).first()
    assert tuple(row) == (-1, 0, 0, 1)


@pytest.mark.parametrize("patterns, exact", [(["^cpu"], []), (["total$", "^d.*b$"], ["net"]), ([], ["mem", "cpu"]), ([], [])])
@pytest.mark.parametrize("after, before", [(None, None), (0, 2 * DAY_NS), (DAY_NS - 1, None)])
def test_same_rows_as_a_plain_scan(spark, points, stored, patterns, exact, after, before):
    wanted = scan_measurements(points, patterns, exact)
    if after is not None:
        wanted = wanted.where(F.col("time") > after)
    if before is not None:
        wanted = wanted.where(F.col("time") < before)
    got = scan_stored(spark, stored, patterns, exact, after, before)
    assert ids(got) == ids(wanted) and set(got.columns) == {"id", "measurement", "time"}


def test_limit_per_series(spark, stored):
    assert ids(scan_stored(spark, stored, ["^cpu"], per_series_limit=2)) == [0, 1, 5, 6]


def test_patterns_and_days_choose_the_folders(spark, stored):
    every = files_read(read_measurements(spark, stored))
    by_pattern = scan_stored(spark, stored, ["total$"])
    assert "dynamicpruning" in plan_of(by_pattern)
    days = len({t // 100 for t in range(600)})
    assert every == 5 * days and files_read(by_pattern) == days
    # days -1 and 0 of two measurements
    assert files_read(scan_stored(spark, stored, ["^cpu"], before=DAY_NS)) <= 2 * 3
    assert files_read(scan_stored(spark, stored, exact=["mem"], after=4 * DAY_NS)) == 1


def test_buckets_join_without_an_exchange(spark):
    cpu = spark.createDataFrame([(1, "h", 1.0, 2.0, None), (2, "h", 4.0, 5.0, 6.0)], "time long, host string, cpu_8 double, cpu_13 double, cpu_14 double")
    mem = spark.createDataFrame([(1, "h", 1.0, 2.0, 3.0), (2, "h", 4.0, None, 6.0)], "time long, host string, mem_2 double, mem_7 double, mem_12 double")
    name = "ContainerResource_container_e17_1704067200000_0011_01_000002"
    nm = spark.createDataFrame(
        [(1, "Hostname=h", 1.0, 7.0, 3.0, 4.0, name), (2, "Hostname=h", 1.0, 8.0, 3.0, 4.0, name)],
        "time long, host string, nm_39 double, nm_44 double, nm_51 double, nm_58 double, nm_100 string",
    )
    jobs = spark.createDataFrame([("application_1704067200000_0011", 9.5)], "app_id string, job_value double")
    label = scratch_path(spark, "b").rpartition("-")[2]
    tables = [write_bucketed(df, f"{n}_{label}", buckets=4) for n, df in (("cpu", cpu), ("mem", mem), ("nm", container_rows(nm)))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = unify_containers(*tables, jobs)
        plan = plan_of(rows)
        # the job join moves both its sides, nothing below does
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 2
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, unify(cpu, mem, nm, jobs).collect()))
        assert rows.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("cpu", "mem", "nm"):
            spark.sql(f"DROP TABLE {n}_{label}")
