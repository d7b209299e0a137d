"""The log-structured table against whole-table upserts: results, bytes written, readers, writers at once, compaction; and Bloom filters."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from vitalgrain.functions.errors import ValidationError
from vitalgrain.operators import bloom, joins
from vitalgrain.operators.log_table import EVERY, LogTable

KIND = "k string, a long, b string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def change(rng, n, keys=60):
    return [(rng.choice([None, *map(str, range(keys))]) if rng.random() < 0.1 else str(rng.randrange(keys)), rng.choice([None, rng.randrange(9)]), rng.choice([None, "", "x", "y"])) for _ in range(n)]


def test_changes_merge_as_whole_upserts_do(spark, tmp_path):
    rng, table, whole = random.Random(1), LogTable(spark, f"file://{tmp_path}/t"), None
    for i in range(5):
        new = spark.createDataFrame(change(rng, 40), KIND)
        table.upsert(new, "k", 4)
        if whole is None:
            whole = joins.upsert(spark.createDataFrame([], KIND), new, "k")
        else:
            whole = joins.upsert(whole, new, "k")
        if i == 2:
            assert table.compact(2) == 4 and table.compact(2) is None
    assert rows_of(table.read()) == rows_of(whole)
    assert rows_of(table.read(keys=["3", "7", "nobody"])) == [r for r in rows_of(whole) if r[0] in ("3", "7")]


def test_bytes_follow_the_change_and_readers_keep_their_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = LogTable(spark, path)
    table.upsert(spark.range(20_000).selectExpr("CAST(id AS STRING) AS k", "id AS a", "sha2(CAST(id AS STRING), 256) AS b"), "k")
    first, before = written(path), table.read()
    table.upsert(spark.createDataFrame([("5", 55, None)], KIND), "k")
    assert written(path) - first < first / 100
    assert before.where("k = '5'").head().a == 5 and table.read().where("k = '5'").head().a == 55 and table.read(1).where("k = '5'").head().a == 5
    asked = table.read(keys=["5"])
    assert len(asked.inputFiles()) == 2 and len(table.read().inputFiles()) == 17
    table.compact(2)
    assert before.where("k = '5'").head().a == 5 and table.read().where("k = '5'").head().a == 55 and table.read().count() == 20_000
    assert table.vacuum(1) == 2 and table.read().where("k = '5'").head().a == 55


def test_writers_at_once_lose_nothing(spark, tmp_path):
    table = LogTable(spark, f"{tmp_path}/t")
    table.upsert(spark.createDataFrame([("0", 0, "")], KIND), "k", 4)
    failed = []

    def write(i):
        try:
            LogTable(spark, f"{tmp_path}/t").upsert(spark.createDataFrame([(str(i), i, "")], KIND).withColumn(f"c{i}", F.lit(i)), "k")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r.k for r in table.read().collect()) == list("0123456") and table.version().number == 7
    assert {f"c{i}" for i in range(1, 7)} <= set(table.read().columns) and table.read().where("k = '4'").head().c4 == 4


def test_a_change_during_compaction_goes_over_it(spark, tmp_path):
    table = LogTable(spark, f"{tmp_path}/t")
    for i in range(3):
        table.upsert(spark.createDataFrame([("x", i, str(i))], KIND), "k", 1)
    merged = table._merged

    def slow(*args):
        table._merged = merged
        LogTable(spark, f"{tmp_path}/t").upsert(spark.createDataFrame([("x", 77, None)], KIND), "k")
        return merged(*args)

    table._merged = slow
    assert table.compact(2) == 5 and rows_of(table.read()) == [("x", 77, "2")]
    other = LogTable(spark, f"{tmp_path}/t")
    found = other.version()
    other.compact(2)
    with pytest.raises(ValidationError):  # what it has folded is gone
        table._commit(found, {"id": "z", "key": "k", "buckets": 1, "schema": {"type": "struct", "fields": []}, "adds": [], "removes": sorted(found.folders)}, lambda now: all(at in now.folders for at in found.folders))


def test_many_versions_and_new_columns(spark, tmp_path):
    table = LogTable(spark, f"{tmp_path}/t")
    for i in range(EVERY + 2):
        df = spark.createDataFrame([(str(i % 3), i)], "k string, a long")
        table.upsert(df.withColumn("late", F.lit("new")) if i == 5 else df, "k", 1)
    assert "state" in table._entry(EVERY) and len(table.version().folders) == EVERY + 2
    assert rows_of(table.read()) == [("0", 21, None), ("1", 19, None), ("2", 20, "new")]
    with pytest.raises(ValidationError):
        table.upsert(spark.createDataFrame([("1", "text")], "k string, a string"), "k")


def test_filter_never_misses_and_rarely_lies(spark):
    known, other = spark.range(5000).selectExpr("CAST(id AS STRING) AS h"), spark.range(5000, 15_000).selectExpr("CAST(id AS STRING) AS h")
    blocks = bloom.blocks_for(5000)
    found = bloom.merge(bloom.build(known.where("h < '3'"), "h", blocks), bloom.build(known.where("h >= '3'"), "h", blocks))
    assert bloom.mark(known, "h", found, blocks, "m").where("NOT m").count() == 0
    assert bloom.mark(other, "h", found, blocks, "m").where("m").count() < 200
    assert rows_of(found) == rows_of(bloom.build(known, "h", blocks))
    assert not bloom.mark(spark.createDataFrame([(None,)], "h string"), "h", found, blocks, "m").head().m


@pytest.mark.parametrize("full", [False, True])
def test_anti_join_by_filters_is_exact(spark, full):
    known = spark.createDataFrame([(str(i % 400),) for i in range(800)] + [(None,)], "h string")
    new = spark.createDataFrame([(str(i), i) for i in range(300, 700)] + [("310", -1), (None, -2), ("900", -3), ("900", -4)], "h string, n long")
    found = bloom.build(known, "h", 2)
    if full:
        found = spark.range(2).select(F.col("id").alias("block"), F.unhex(F.repeat(F.lit("FF"), 4096)).alias("bits"))
    want = sorted([n for n in range(400, 700)] + [-2, -3, -4])
    for reverse in (None, 400):
        assert sorted(r.n for r in bloom.anti_join(new, known, "h", found, 2, reverse).collect()) == want
    assert sorted(r.n for r in bloom.anti_join(new, known, "h").collect()) == want


def test_known_content_isnt_written_again(spark, tmp_path):
    kind = "k string, name string, day string"
    table = LogTable(spark, f"{tmp_path}/t")
    assert table.upsert_new_content(spark.createDataFrame([("1", "Ann", "x"), ("2", "Bob", "y")], kind), "k", ["name", "day"]) == 1
    assert table.upsert_new_content(spark.createDataFrame([("3", " ann ", "x"), ("4", "Bob", "y")], kind), "k", ["name", "day"]) is None
    before = written(f"{tmp_path}/t/data")
    assert table.upsert_new_content(spark.createDataFrame([("5", "ANN", "x"), ("6", "Cy", "z")], kind), "k", ["name", "day"]) == 2
    assert sorted(r.k for r in table.read().collect()) == ["1", "2", "6"] and written(f"{tmp_path}/t/data") > before
    assert table.compact(1) == 3 and len(table.version().filters) == 2
    assert table.upsert_new_content(spark.createDataFrame([("7", "Cy", "z"), ("8", "Di", "w")], kind), "k", ["name", "day"]) == 4
    table.upsert(spark.createDataFrame([("9", "Ed", "v")], kind), "k")  # of no filter: from now on all are looked up
    assert table.version().filters is None and table.upsert_new_content(spark.createDataFrame([("a", "Di", "w")], kind), "k", ["name", "day"]) is None
