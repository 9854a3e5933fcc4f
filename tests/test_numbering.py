"""Row numbers over many partitions: hot keys, copies, nulls."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from metricweave.operators import numbering
from metricweave.operators.numbering import number_rows
from metricweave.operators.batches import assign_batches
from metricweave.operators.projection import drop_last
from metricweave.operators.sampling import half_cut, half_of, row_total, shuffle_key, shuffle_rows, split_half
from metricweave.session import store


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep the small test tables from being merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def numbers(df, name="row_number"):
    return sorted(r[name] for r in df.select(name).collect())


def test_follows_composite_order_across_partitions(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).cast("string").alias("a"), (1000 - F.col("id")).alias("b")
    ).repartition(5)
    got = number_rows(df, ["a", "b"]).collect()
    want = {(r["a"], r["b"]): i for i, r in enumerate(sorted(df.collect()), 1)}
    assert {(r["a"], r["b"]): r["row_number"] for r in got} == want


def test_nulls_come_first_in_every_column(spark):
    rows = [(None, 2), (None, None), ("a", None), ("a", 1), ("b", 0)]
    df = spark.createDataFrame(rows, "a string, b int")
    got = {(r["a"], r["b"]): r["row_number"] for r in number_rows(df, ["a", "b"]).collect()}
    assert got == {(None, None): 1, (None, 2): 2, ("a", None): 3, ("a", 1): 4, ("b", 0): 5}


def test_timestamps_doubles_and_decimals_are_ordered(spark):
    df = spark.range(300).select(
        F.timestamp_micros(F.col("id") % 10 - 5).alias("ts"),
        F.timestamp_micros(F.col("id") % 5).cast("timestamp_ntz").alias("ntz"),
        ((F.col("id") - 150) / 7).alias("x"),
        F.col("id").cast("decimal(20,3)").alias("d"),
    )
    got = number_rows(df, ["ts", "ntz", "x", "d"]).orderBy("row_number").collect()
    keys = [tuple(r)[:4] for r in got]
    assert keys == sorted(keys) and [r["row_number"] for r in got] == list(range(1, 301))


def partition_sizes(df):
    """Rows per file behind a numbered table; one file is one sorted partition."""
    return [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]


def stored_partitions(spark, monkeypatch, *args, **options):
    kept = []
    keep = lambda df, label: kept.append((label, store(df, label))) or kept[-1][1]
    monkeypatch.setattr(numbering, "store", keep)
    got = number_rows(*args, **options)
    return got, partition_sizes(dict(kept)["ordered"])


def test_hot_key_is_spread_over_partitions(spark, monkeypatch):
    # a third of the rows share the leading key
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("key"), "id"
    )
    got, sizes = stored_partitions(spark, monkeypatch, df, ["key", "id"])
    assert len(sizes) == 4 and max(sizes) < 30_000 / 3
    assert got.agg(F.countDistinct("row_number")).first()[0] == 30_000


def test_equal_rows_are_spread_over_partitions(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("key"))
    got, sizes = stored_partitions(spark, monkeypatch, df, ["key"], unique=False)
    assert len(sizes) == 4 and max(sizes) < 30_000 / 3
    assert got.agg(F.countDistinct("row_number")).first()[0] == 30_000


def test_copies_get_distinct_consecutive_numbers(spark):
    # a third of the rows are one and the same row
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.lit("x").alias("text")
    )
    got = number_rows(df, ["key"], unique=False)
    assert numbers(got) == list(range(1, 901))
    ordered = [r["key"] for r in got.orderBy("row_number").collect()]
    assert ordered == sorted(ordered) and ordered.count(0) == 300


def test_ties_on_the_order_key_keep_every_row(spark):
    df = spark.range(500).select(F.lit(1).alias("key"), "id")
    got = number_rows(df, ["key"], unique=False)
    assert numbers(got) == list(range(1, 501))
    assert got.select("id").distinct().count() == 500


def test_empty_table(spark):
    df = spark.range(0)
    assert number_rows(df, ["id"]).count() == 0
    assert number_rows(df, ["id"], unique=False).count() == 0
    assert split_half(df, ["id"], 1).count() == 0
    assert drop_last(df, ["id"]).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-2, 2)), max_size=40))
def test_any_bag_of_rows_is_numbered_in_order(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int")
    got = number_rows(df, ["a", "b"], unique=False).orderBy("row_number").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows)
    assert [r["row_number"] for r in got] == list(range(1, len(rows) + 1))


def test_numbers_stay_the_same_when_read_again(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("key"), "id")
    got = number_rows(df, ["key"], unique=False)
    first, again = (dict(d.select("id", "row_number").collect()) for d in (got, got.repartition(5)))
    assert first == again


@pytest.mark.parametrize("rows, size, tail, batches", [
    (12, 5, "keep", 3), (12, 5, "full", 2), (12, 5, "skip_last", 1), (10, 5, "full", 2), (4, 5, "full", 0), (4, 5, "skip_last", 0),
])
def test_batch_tails(spark, rows, size, tail, batches):
    got = assign_batches(spark.range(rows), ["id"], size, tail).collect()
    assert {r["batch"] for r in got} == set(range(batches))
    assert all(r["batch"] == r["id"] // size and r["batch_row"] == r["id"] % size for r in got)


def test_unknown_tail(spark):
    with pytest.raises(ValueError):
        assign_batches(spark.range(3), ["id"], 2, "other")


@pytest.mark.parametrize("rows", [0, 1, 2, 101, 1000])
def test_halves_follow_the_permutation(spark, rows):
    df = spark.range(rows)
    placed = shuffle_rows(df, ["id"], 3)
    assert numbers(placed, "position") == list(range(1, rows + 1))
    by_rank = dict(placed.select("id", half_of(F.col("position"), row_total(df))).collect())
    by_cut = dict(split_half(df, ["id"], 3).collect())
    assert by_rank == by_cut
    assert sum(h == "train" for h in by_cut.values()) == rows // 2


@pytest.mark.parametrize("bucket_rows", [1, 3, 50])
def test_the_middle_is_found_in_rounds(spark, bucket_rows):
    df = spark.range(4001)
    hashes = sorted(r[0] for r in df.select(shuffle_key(["id"], 9)).collect())
    assert half_cut(df, ["id"], 9, bucket_rows) == hashes[1999]


def test_permutation_depends_on_the_seed(spark):
    df = spark.range(200)
    first, again, other = (
        [r["id"] for r in shuffle_rows(df, ["id"], s).orderBy("position").collect()] for s in (1, 1, 2)
    )
    assert first == again != other and sorted(first) == list(range(200)) != first


def test_half_of_copies_is_exact(spark):
    df = spark.range(99).select(F.lit("same").alias("key"))
    halves = split_half(df, ["key"], 1, unique=False).groupBy("half").count().collect()
    assert dict(map(tuple, halves)) == {"train": 49, "test": 50}


def test_drop_last(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (2, None)], "n int, s string")
    assert sorted(r["n"] for r in drop_last(df, ["n"]).collect()) == [1, 2]
    tied = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (2, "b")], "n int, s string")
    assert sorted(r["n"] for r in drop_last(tied, ["n"], unique=False).collect()) == [1, 2, 2]


def test_large_table_is_never_sorted_in_one_task(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("key"))
    plan = number_rows(df, ["key"])._jdf.queryExecution().executedPlan().toString()
    main = plan[: plan.index("BroadcastExchange")]
    # what is left to do is read the sorted table and add the offsets
    assert "Exchange" not in main and "Sort" not in main and "NestedLoop" not in plan
