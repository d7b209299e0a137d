"""Results in the shared folder: other sessions, changed tables, expiry, one writer."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from vitalgrain.functions.errors import ValidationError
from vitalgrain.operators.shared_cache import SharedCache


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def results(tmp_path):
    return sorted(p.name for p in tmp_path.glob("cache/*/result-*"))


def test_sessions_share_results_until_tables_change(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    clock = Clock()
    ask = lambda s, role="admin", most=100: SharedCache(s, f"{tmp_path}/cache", 60, clock=clock).get("sum", {"a": 1}, role, s.read.parquet(f"{tmp_path}/t").where(F.col("id") < most).agg(F.sum("id").alias("n"))).head().n
    assert ask(spark) == 45 and ask(spark.newSession()) == 45 and len(results(tmp_path)) == 1
    assert ask(spark, "public") == 45 and ask(spark, most=3) == 3 and len(results(tmp_path)) == 3
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    assert ask(spark.newSession()) == 55 and len(results(tmp_path)) == 4
    clock.now += 61
    assert ask(spark) == 55 and len(results(tmp_path)) == 5
    assert SharedCache(spark, f"{tmp_path}/cache", 60, clock=clock).expire() == 4
    assert SharedCache(spark, f"{tmp_path}/cache").invalidate("other") == 0 and SharedCache(spark, f"{tmp_path}/cache").invalidate("sum") == 4
    with pytest.raises(ValidationError):
        SharedCache(spark, f"{tmp_path}/cache").get("x", {}, "admin", spark.createDataFrame([(1,)], "a int"))


def test_one_writer_and_lost_ones(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    made, got = [], []

    def ask():
        cache = SharedCache(spark, f"{tmp_path}/cache")
        df = spark.read.parquet(f"{tmp_path}/t").agg(F.count("*").alias("n"))
        got.append(cache.get("n", {}, "admin", df).head().n)

    threads = [threading.Thread(target=ask) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [10] * 4 and len(results(tmp_path)) == 1
    (result,) = tmp_path.glob("cache/*/result-*")  # a writer that died has left its claim alone
    for f in result.parent.glob("*result-*"):
        f.unlink()
    began = time.time()
    cache = SharedCache(spark, f"{tmp_path}/cache", lease=began - 10**9, sleep=lambda s: made.append(s))
    cache.lease = 0
    assert cache.get("n", {}, "admin", spark.read.parquet(f"{tmp_path}/t").agg(F.count("*").alias("n"))).head().n == 10 and not made
