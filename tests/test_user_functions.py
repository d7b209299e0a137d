"""User aggregates, the table function, facets in one scan, and checks of request logs."""

import pytest
from pyspark.sql import functions as F

from vitalgrain.functions import user
from vitalgrain.operators import request_log
from vitalgrain.plans import pipeline


def test_aggregates_merge_partial_states(spark, monkeypatch):
    monkeypatch.setattr(user, "FLUSH", 2)
    rows = [(k, float(i % 13)) for i in range(500) for k in ("hot", "hot", f"k{i % 7}")] + [(None, 1.0), (None, 3.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {r.k: r.x for r in df.groupBy("k").agg(F.var_pop("v").alias("x")).collect()}
    got = {r.k: r.x for r in user.user_aggregate(df, ["k"], "v", user.VARIANCE, "x").collect()}
    assert set(got) == set(want) and got["empty"] is None
    assert all(got[k] == pytest.approx(want[k]) for k in want if want[k] is not None)
    assert user.user_aggregate(df.limit(0), ["k"], "v", user.VARIANCE, "x").count() == 0
    longest = user.Aggregate(lambda: "", lambda s, v: max(s, v, key=len), lambda a, b: max(a, b, key=len), len, "int")
    words = spark.createDataFrame([("a", "x"), ("a", "xyz"), ("b", "xy")], "k string, w string")
    assert {(r.k, r.n) for r in user.user_aggregate(words, ["k"], "w", longest, "n").collect()} == {("a", 3), ("b", 2)}


def test_sessions_by_table_function(spark):
    rows = [("a", 0), ("a", 50), ("a", 200), ("b", 5), ("a", None), (None, 1)]
    df = spark.createDataFrame(rows, "u string, s long").select("u", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"))
    got = {(r.user, r.session, r.n) for r in user.sessions(df, "u", "at", 100.0).collect()}
    assert got == {("a", 1, 2), ("a", 2, 1), ("b", 1, 1), (None, 1, 1)}
    with pytest.raises(Exception, match="no column"):
        user.sessions(df, "nobody", "at", 100.0).collect()


def test_facets_share_a_scan(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS v", "CAST(id % 2 AS STRING) AS s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    parts = {
        "ks": [{"$group": {"_id": "$k", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": -1}}, {"$limit": 2}],
        "big": [{"$match": {"v": {"$gte": 90}}}, {"$count": "n"}],
        "none": [{"$match": {"v": {"$gt": 900}}}, {"$count": "n"}],
    }
    once = pipeline.compile_pipeline(df, [{"$facet": parts}])
    assert once._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    row = once.head()
    assert [(x._id, x.n) for x in row.ks] == [(0, 34), (2, 33)] and row.big[0].n == 10 and row.none[0].n == 0
    mixed = pipeline.compile_pipeline(df, [{"$facet": parts | {"rows": [{"$match": {"v": {"$lt": 2}}}]}}])  # a part of another shape
    assert mixed.columns == ["ks", "big", "none", "rows"] and [x.v for x in mixed.head().rows] == [0, 1]


def test_request_logs(spark):
    df = spark.createDataFrame([("p-1", "Ann", 5, "2024-01-01", "2024-02-01"), ("p 1", "a_b", 0, "2024-02-30", "x"), (None, None, None, None, None)], "p string, n string, l long, s string, e string")
    got = [r.x for r in df.select(request_log.problems("p", "n", "l", "s", "e").alias("x")).collect()]
    assert got == [[], ["patient_id", "name", "limit", "start", "end"], []]
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,)], "k long")

    def f(row, attempt):
        if row["k"] == 3:
            raise ValueError("bad")
        if attempt <= row["k"]:
            raise TimeoutError("late")
        return row["k"] * 10

    tried = {r.k: (r.out, r.tries, r.error) for r in request_log.tried(rows, f, "out", 2).collect()}
    assert tried == {0: ("0", 1, None), 1: ("10", 2, None), 2: (None, 2, "source_error"), 3: (None, 1, "engine_error")}
