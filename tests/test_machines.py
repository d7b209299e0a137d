"""State machines over streams: order, restarts, late rows, timers, and equality with the batch folds."""

import random

import pytest
from pyspark.sql import functions as F

from vitalgrain.operators import limits
from vitalgrain.streaming import bounded, machines, stateful

KIND = "k string, n long, ts timestamp, what string, more string"
DAY = 86_400
START = 1000 * DAY


def play(spark, machine, pieces, late="1 hour", end=True):
    """Transitions of rows (key, tie, seconds, what, more) that come in pieces, each by a run of its own; rows left out as late."""
    at, schema, lost = bounded.shared_folder(spark), spark.createDataFrame([], KIND).schema, 0
    for i, rows in enumerate(pieces):
        df = spark.createDataFrame([(k, n, s if s is None else float(s + START), w, m) for k, n, s, w, m in rows], "k string, n long, s double, what string, more string")
        df.select("k", "n", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "what", "more").coalesce(1).write.mode("append").parquet(f"{at}/in")
        if end and i == len(pieces) - 1:
            machines.close(spark, f"{at}/in", schema, "ts")
        stream = machines.transitions(stateful.file_stream(spark, f"{at}/in", schema, 1000), machine, "k", "ts", "n", F.col("what"), F.col("more"), late)
        lost += machines.run(stream, f"{at}/out", f"{at}/checkpoint").late
    found = spark.read.schema(machines.OUT).parquet(f"{at}/out").collect()
    return sorted(((r.key, r.micros / 1e6 - START, r.tie, r.what) for r in found), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)), lost


def test_sessions_expire_and_move(spark):
    rows = [
        ("a", 1, 0, "login", "x"), ("a", 2, 10, "request", "x"), ("a", 3, 1800, "request", "x"), ("a", 4, 1801, "request", "x"),
        ("b", 5, 0, "request", "x"), ("b", 6, 5, "login", "x"), ("b", 7, 9, "request", "y"), ("b", 8, 11, "request", "x"),
        ("c", 9, 0, "login", "x"), ("c", 10, 30, "logout", "x"), ("c", 11, 31, "request", "x"), (None, 12, 3, "login", "x"), ("d", 13, None, "login", "x"),
    ]
    got, late = play(spark, machines.Session(1800), [rows])
    assert late == 0
    assert [(k, n, w) for k, _, n, w in got] == [
        ("a", 1, "created"), ("a", 2, "valid"), ("a", 3, "valid"), ("a", None, "expired"), ("a", 4, "unknown"),
        ("b", 5, "unknown"), ("b", 6, "created"), ("b", 7, "moved"), ("b", 8, "unknown"), ("c", 9, "created"), ("c", 10, "revoked"), ("c", 11, "unknown"),
    ]


def test_dead_letters_wait_twice_as_long_each_time(spark):
    rows = [("a", 1, 0, "failed", ""), ("a", 2, 10, "failed", ""), ("a", 3, 400, "failed", ""), ("a", 4, 2000, "failed", ""), ("a", 5, 2001, "retried", ""), ("b", 6, 0, "failed", ""), ("b", 7, 1, "failed", ""), ("b", 8, 2, "resolved", "")]
    got, _ = play(spark, machines.DeadLetter(most=3, base=300), [rows])
    assert [(k, t, n, w) for k, t, n, w in got if k == "a"] == [("a", 0, 1, "pending"), ("a", 10, 2, "retry_scheduled"), ("a", 310, None, "due"), ("a", 400, 3, "retry_scheduled"), ("a", 1000, None, "due"), ("a", 2000, 4, "archived")]
    assert [w for k, _, _, w in got if k == "b"] == ["pending", "retry_scheduled", "resolved"]


def test_breaker_reopens_after_three_failed_probes_and_closes_by_one(spark):
    calls = "FFFFF" + "O" + "F" * 3 + "O" + "OF"
    times = [0, 1, 2, 3, 4, 5, 64, 65, 66, 67, 126, 127]
    rows = [("s", i, t, "ok" if c == "O" else "failed", "") for i, (c, t) in enumerate(zip(calls, times, strict=True))]
    got, _ = play(spark, machines.Breaker(), [rows])
    assert [w for *_, w in got] == ["closed"] * 5 + ["open"] + ["half_open"] * 3 + ["open"] + ["half_open", "closed"]


def test_late_rows_are_left_out_and_counted(spark):
    pieces = [[("a", 1, 10 * DAY, "started", "")], [("a", 2, 10 * DAY + 5, "in_progress", ""), ("a", 3, DAY, "failed", ""), ("b", 4, 9.99 * DAY, "started", "")]]
    got, late = play(spark, machines.Checkpoint(), pieces)
    assert late == 1 and [(k, n, w) for k, _, n, w in got if n] == [("a", 1, "started"), ("a", 2, "in_progress"), ("b", 4, "started")]


@pytest.mark.parametrize("seed", [1, 2])
def test_arrival_doesnt_matter_and_restarts_lose_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), i, round(rng.uniform(0, 3000), 3), rng.choice(["ok", "failed", "failed"]), "") for i in range(300)]
    pieces = [[], [], []]
    for r in rows:
        pieces[min(2, int((r[2] + rng.uniform(0, 900)) // 1000))].append(r)
    for p in pieces:
        rng.shuffle(p)
    df = spark.createDataFrame(rows, "k string, n long, s double, what string, more string").select("k", "n", F.timestamp_micros(((F.col("s") + START) * 1_000_000).cast("long")).alias("ts"), (F.col("what") == "ok").alias("ok"))
    got, late = play(spark, machines.Breaker(3, 60, 2, 2), pieces)
    want = limits.circuit_breaker(df, "k", "ts", "ok", 3, 60.0, 2, 2, "n").collect()
    assert late == 0 and {n: w for *_, n, w in got} == {r.n: r.state for r in want}
    got, late = play(spark, machines.RateLimit(3, 60), pieces)
    want = limits.rate_limit(df, "k", "ts", 3, 60.0, "n").collect()
    assert late == 0 and {n: w == "allowed" for *_, n, w in got} == {r.n: r.allowed for r in want}


def test_an_open_stream_holds_back_what_may_still_change(spark):
    rows = [("a", 1, 0, "request", ""), ("a", 2, 10_000, "request", "")]
    got, _ = play(spark, machines.RateLimit(1, 60), [rows], late="1 hour", end=False)
    assert [n for _, _, n, _ in got] == [1]
