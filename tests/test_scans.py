"""Prefix scans and block folds of hot keys against windows and plain folds."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrain.operators import limits, scans


def events(spark, n=3000, hot=0.9, seed=1, span=20_000.0):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), round(rng.uniform(0, span), 2), rng.choice([None, rng.uniform(-5, 5)]), rng.random() < 0.4) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k string, s double, v double, ok boolean")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s").repartition(7)


def values(df, *columns):
    return {r.id: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("ranges", [1, 16])
def test_scan_equals_windows(spark, ranges):
    df = events(spark)
    by = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = values(df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).alias("n"), F.avg("v").over(by).alias("m"), F.coalesce(F.sum("v").over(by), F.lit(0.0)).alias("s")), "n", "m", "s")
    got = scans.prefix_scan(df, "k", ["ts", "id"], {"s": F.col("v")}, number="n", ranges=ranges)
    assert values(got, "n", "s") == {i: (n, s) for i, (n, _, s) in want.items()} and set(df.columns) | {"n", "s"} == set(got.columns)
    assert values(scans.running_mean(df, "k", ["ts", "id"], "v", ranges=ranges), "running_mean") == {i: (m,) for i, (_, m, _) in want.items()}
    assert values(scans.flushes(df, "k", ["ts", "id"], 10, ranges=ranges), "flush") == {i: ((n - 1) // 10,) for i, (n, _, _) in want.items()}


def test_a_hot_key_takes_many_tasks(spark):
    df = events(spark, 4000, hot=0.95)
    sizes = [r[0] for r in scans.prefix_scan(df, "k", ["ts", "id"], number="n", ranges=8).groupBy("k", F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 4000
    ranged = df.repartitionByRange(8, "k", "ts", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 2 * 4000 / 8


def test_scan_of_little(spark):
    assert scans.prefix_scan(events(spark, 0), "k", ["id"], number="n").count() == 0
    one = scans.prefix_scan(spark.createDataFrame([(None, 1)], "k string, n long"), "k", ["n"], number="n").collect()
    assert [tuple(r) for r in one] == [(None, 1)]


@pytest.mark.parametrize(("windows", "span"), [(1, 20_000.0), (5, 2_000.0)])
def test_block_forms_equal_plain_ones(spark, windows, span):
    df = events(spark, 600, span=span, seed=windows)
    assert values(limits.requests_in_blocks(df, "k", "ts", 60, windows), "in_window") == values(limits.requests_in_window(df, "k", "ts", 60), "in_window")
    known = df.where("k IS NOT NULL")
    got = limits.rate_limit_blocks(known, "k", "ts", "id", 5, 60.0, windows)
    assert values(got, "allowed") == values(limits.rate_limit(known, "k", "ts", 5, 60.0, "id"), "allowed")
    got = limits.circuit_breaker_blocks(known, "k", "ts", "ok", "id", 3, 90.0, 2, 2, seconds=100.0 * windows)
    assert values(got, "state") == values(limits.circuit_breaker(known, "k", "ts", "ok", 3, 90.0, 2, 2, "id"), "state")


def test_rows_without_time_have_no_verdict(spark):
    df = events(spark, 20).unionByName(events(spark, 1).selectExpr("id + 100 AS id", "k", "v", "ok", "CAST(NULL AS TIMESTAMP) AS ts"))
    assert limits.rate_limit_blocks(df, "k", "ts", "id").where("id = 100").head().allowed is None
    assert limits.requests_in_blocks(df, "k", "ts").where("id = 100").head().in_window is None and limits.requests_in_blocks(df, "k", "ts").count() == 21
