"""Operators that SQL twins don't reach: sinks, folds, streams, errors and masks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitalgrain.functions import errors, filters
from vitalgrain.operators import governance, joins, limits, quality, sinks
from vitalgrain.operators.sketches import percentile_index
from vitalgrain.plans import pipeline, tools
from vitalgrain.streaming import stateful

T0 = datetime(2024, 1, 1)


def brute_limit(times, limit, seconds):
    seen, out = [], []
    for t in times:
        seen = [x for x in seen if (t - x).total_seconds() < seconds]
        out.append(len(seen) < limit)
        if out[-1]:
            seen.append(t)
    return out


def requests(spark):
    rows = [(k, T0 + timedelta(seconds=s), i) for k in ("a", "b") for i, s in enumerate([0, 1, 2, 30, 59.999999, 60.0, 61, 62, 90, 119, 120.5])]
    return spark.createDataFrame(rows, "who string, ts timestamp_ntz, n int"), rows


def test_rate_limit_is_exact(spark):
    df, rows = requests(spark)
    got = {(r.who, r.n): r.allowed for r in limits.rate_limit(df, "who", "ts", 3, 60.0).collect()}
    want = brute_limit([r[1] for r in rows if r[0] == "a"], 3, 60.0)
    assert [got["a", i] for i in range(len(want))] == want == [got["b", i] for i in range(len(want))]


def test_circuit_breaker(spark):
    calls = [(0, False), (1, False), (2, True), (30, True), (63, True), (64, True), (65, False), (66, False)]
    df = spark.createDataFrame([("s", T0 + timedelta(seconds=t), ok) for t, ok in calls], "k string, ts timestamp_ntz, ok boolean")
    states = [r.state for r in limits.circuit_breaker(df, "k", "ts", "ok", failures=2, rest=60.0, probes=2).orderBy("ts").collect()]
    assert states == ["closed", "closed", "open", "open", "half_open", "half_open", "closed", "closed"]


def test_streams(spark, tmp_path):
    df, rows = requests(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = stateful.file_stream(spark, f"{tmp_path}/in", df.schema)
    stateful.run_available(stateful.rate_limit(stream, "who", "ts", 3, 60.0), f"{tmp_path}/c1", lambda d, _: got.extend(d.collect()))
    want = brute_limit([r[1] for r in rows if r[0] == "a"], 3, 60.0)
    assert [r.allowed for r in sorted(got, key=lambda r: r.ts) if r.key == "a"] == want
    kept = []
    stateful.run_available(stateful.dedup(stream, "ts", ["who"]), f"{tmp_path}/c2", lambda d, _: kept.extend(d.collect()))
    assert sorted(r.who for r in kept) == ["a", "b"]
    counts = []
    stateful.run_available(stateful.windowed_counts(stream, "ts", "who", "1 minute", "0 seconds"), f"{tmp_path}/c3", lambda d, _: counts.extend(d.collect()))
    assert {(r.who, r["count"]) for r in counts} >= {("a", 5), ("b", 5)}


def test_sinks(spark, tmp_path):
    at = f"{tmp_path}/t"
    sinks.upsert_table(spark.createDataFrame([("1", "a", None), ("2", "b", 5)], "id string, x string, y int"), at, "id")
    sinks.upsert_table(spark.createDataFrame([("2", None, 6), ("3", "c", 7)], "id string, x string, y int"), at, "id")
    assert {tuple(r) for r in spark.read.parquet(at).collect()} == {("1", "a", None), ("2", "b", 6), ("3", "c", 7)}
    sinks.upsert_new_content(spark.createDataFrame([("9", "Q")], "id string, x string"), f"{tmp_path}/u", "id", ["x"])
    sinks.upsert_new_content(spark.createDataFrame([("10", " q "), ("11", "r")], "id string, x string"), f"{tmp_path}/u", "id", ["x"])
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/u").collect()} == {"9", "11"}
    sinks.append_log(spark.createDataFrame([("e",)], "event string"), f"{tmp_path}/log")
    sinks.append_log(spark.createDataFrame([("f",)], "event string"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_a_swap_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    spark.range(3).write.parquet(at)
    with pytest.raises(FileNotFoundError):
        sinks.swap(spark, f"{tmp_path}/absent", at)
    assert spark.read.parquet(at).count() == 3
    spark.range(5).write.parquet(f"{tmp_path}/new")
    real = sinks._hadoop

    class Stubborn:
        """A file system whose n-th rename reports failure without an exception."""

        def __init__(self, fs, n):
            self.fs, self.n = fs, n

        def rename(self, a, b):
            self.n -= 1
            return False if self.n == 0 else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    for n in (1, 2):
        monkeypatch.setattr(sinks, "_hadoop", lambda s, p, box=Stubborn(real(spark, at)[1], n): (real(s, p)[0], box))
        with pytest.raises(OSError):
            sinks.swap(spark, f"{tmp_path}/new", at)
        assert spark.read.parquet(at).count() == 3 and spark.read.parquet(f"{tmp_path}/new").count() == 5
    monkeypatch.setattr(sinks, "_hadoop", real)
    sinks.swap(spark, f"{tmp_path}/new", at)
    assert spark.read.parquet(at).count() == 5 and [p.name for p in tmp_path.iterdir() if "old" in p.name or "new" in p.name] == []


def test_rate_limit_stream_over_files_and_frames(spark, tmp_path):
    """Requests that come unordered within a micro-batch, in frames of one row, with the state carried on over batches."""
    times = [0, 1, 2, 30, 59.5, 60, 61, 62, 90, 119, 120.5, 121]
    for some in (times[:6], times[6:]):
        rows = [(k, T0 + timedelta(seconds=t)) for k in ("a", "b") for t in reversed(some)]
        spark.createDataFrame(rows, "who string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    got = []
    try:
        stream = stateful.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        stateful.run_available(stateful.rate_limit(stream, "who", "ts", 3, 60.0), f"{tmp_path}/c", lambda d, _: got.extend(d.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute_limit([T0 + timedelta(seconds=t) for t in times], 3, 60.0)
    for k in "ab":
        assert [r.allowed for r in sorted((r for r in got if r.key == k), key=lambda r: r.ts)] == want


def test_examples_come_in_order(spark):
    from vitalgrain.operators import analytics

    df = spark.createDataFrame([(k, n) for k, c in (("x", 3), ("y", 9), ("z", 5), ("w", 5), ("one", 1)) for n in [f"n{i % 7}" for i in range(c)]] + [(None, "n")], "k string, n string")
    got = [(r.group_key, r["count"], r.examples) for r in analytics.with_examples(df, "k", "n", 2, 3, 2).collect()]
    assert got == [("y", 9, ["n0", "n1"]), ("w", 5, ["n0", "n1"]), ("z", 5, ["n0", "n1"])]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as N

    from vitalgrain.streaming import bounded

    with pytest.raises(ValueError):
        bounded.shared_folder(N(conf=N(get=lambda *_: None), sparkContext=N(master="yarn")))
    assert bounded.shared_folder(N(conf=N(get=lambda *_: "s3://b/c"), sparkContext=N(master="yarn"))).startswith("s3://b/c/streams/")


def test_masks_nest_and_repeat(spark):
    df = spark.createDataFrame([("1", "Ann", ("Ames", "secret"))], "patient_id string, first_name string, details struct<city:string,ssn:string>")
    once = governance.mask(df, "read_only")
    assert once.first().asDict(True) == {"patient_id": "1", "first_name": "Ann", "details": {"city": "Ames"}}
    assert governance.mask(once, "read_only").schema == once.schema
    assert governance.mask(df, "admin") is df and not governance.has_permission("billing", "read_phi") and governance.has_permission("admin", "any")


def test_validation():
    with pytest.raises(errors.ValidationError):
        filters.validate_params({"city": {"$where": "1"}})
    with pytest.raises(errors.ValidationError):
        filters.validate_params({"city": "../x"})
    assert filters.validate_params({"city": "x" * 600, "evil": 1, "state": None}) == {"city": "x" * 500}
    assert filters.query_depth({}) == 1 and filters.query_depth([{"$group": {"_id": "$x", "n": {"$sum": 1}}}]) == 4
    assert filters.normalize_state(" new york ") == "NY" and filters.normalize_state("ca") == "CA" and filters.normalize_state("Ontario") == "Ontario"
    with pytest.raises(errors.ValidationError):
        filters.pattern("patient_medications", {})
    for bad in (lambda: filters.validate_dates("2024-02-30", None), lambda: filters.validate_dates("2024-02-02", "2024-01-01"), lambda: filters.validate_patient_id("a b"), lambda: filters.validate_name("a_b"), lambda: filters.validate_limit(0)):
        with pytest.raises(errors.ValidationError):
            bad()


def test_pipeline_checks(spark):
    assert pipeline.problems_of([{"$out": "x"}, {"$what": 1}, {}]) and not pipeline.problems_of([{"$match": {}}])
    assert pipeline.estimate([{"$lookup": {}}, {"$group": {}}, {"$sort": {}}]) == (6, "medium")
    for query, kind in (("{", "find"), ("{}", "aggregate"), ("[]", "find"), ('[{"$merge": "x"}]', "aggregate"), ("{}", "drop")):
        with pytest.raises(errors.ValidationError):
            pipeline.parse_query(query, kind)
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    out, problems = pipeline.bulk(lambda _: df, [{"collection": "t", "filter": {"x": 1}}, {"collection": "t", "filter": {"nope": 1}}])
    assert out.count() == 1 and problems[0]["query_idx"] == 1 and problems[0]["error"] == "query_error"
    found = errors.enveloped(lambda: spark.table("absent_table").count())()
    assert found["success"] is False and found["error"] == "not_found"


def test_tools_refuse_unknown_groups(spark):
    df = spark.createDataFrame([("1", "x", T0)], "patient_id string, allergy_name string, recorded_ts timestamp_ntz")
    with pytest.raises(errors.ValidationError):
        tools.analyze(tools.ANALYSES["analyze_allergy_patterns"], df, "nonsense")


def test_p95_by_index(spark):
    for n in (1, 2, 19, 20, 21, 400, 5000):
        values = [float((i * 37) % n // (1 + n // 2000)) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "ms double").repartition(5)
        for accuracy in (10_000, 30):  # also with a summary that leaves a bracket
            assert percentile_index(df, "ms", 0.95, accuracy).first().value == sorted(values)[min(int(n * 0.95), n - 1)]
    odd = [1.0, 2.0, 1e300, -1e300, float("inf"), 3.0, float("nan")] + [float(i) / 7 for i in range(40)]
    df = spark.createDataFrame([(v,) for v in odd + [None]], "ms double")
    for accuracy in (10_000, 10):
        for share in (0.5, 0.95, 0.99):
            want = sorted(odd, key=lambda v: (v != v, v))[int(len(odd) * share)]
            got = percentile_index(df, "ms", share, accuracy).first().value
            assert got == want or got != got and want != want
    assert percentile_index(df.where("ms IS NULL"), "ms").first().value is None


def test_p95_runs_no_job_while_planned_and_reads_twice(spark, tmp_path):
    spark.range(100).selectExpr("id * 1.0D AS ms").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    spark.sparkContext.setJobGroup(group, "")
    planned = percentile_index(df, "ms")
    assert not tracker.getJobIdsForGroup(group) and planned._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2


def test_profile_counts_distinct_values_in_one_scan(spark, tmp_path):
    spark.range(3000).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 7 AS STRING) AS b", "CASE WHEN id % 5 > 0 THEN repeat('x', CAST(id % 5 - 1 AS INT)) END AS c", "id % 100 AS d").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = quality.profile(df, df.columns)
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert {r.field: (r.rows, r.nulls, r.blanks, r.distinct_values) for r in found.collect()} == {"a": (3000, 0, 0, 100), "b": (3000, 0, 0, 7), "c": (3000, 600, 600, 4), "d": (3000, 0, 0, 100)}
    assert {r.field: r.distinct_values for r in quality.profile(df, df.columns, most=3000).collect()} == {"a": 3000, "b": 7, "c": 4, "d": 100}


def test_lookup_keeps_rows_without_match(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "j int, v string")
    rows = {r.k: len(r.found) for r in joins.lookup(a, b, "k", "j", "found").collect()}
    assert rows == {1: 2, 2: 0} and joins.unwind(joins.lookup(a, b, "k", "j", "found"), "found").count() == 2


def test_drugs_are_dealt_by_name_and_frequent_names_are_split(spark):
    """A small file of drugs is no small table: none is broadcast, and medications of one name needn't pass one task."""
    settings = {"skewJoin.skewedPartitionThresholdInBytes": "20000", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "10000"}
    old = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in settings}
    name = F.when(F.col("id") % 10 < 8, "Hot").when(F.col("id") % 10 < 9, F.concat(F.lit("d"), F.col("id") % 500))
    medications = spark.range(100_000).repartition(8).select("id", name.alias("medication_name"))
    rows = [(str(i), "hOT" if i < 2 else f"D{i}", "a", "b", "c") for i in range(500)]
    drugs = spark.createDataFrame(rows, "ingredient_rxcui string, primary_drug_name string, therapeutic_class_l2 string, drug_class_l3 string, drug_subclass_l4 string")
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        out = joins.enrich_medications(medications, drugs).select("id", "medication_name", "drug.ingredient_rxcui")
        got = {r.id: (r.medication_name, r.ingredient_rxcui) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
    assert len(got) == 100_000 and all(got[i] == (("Hot", "0") if i % 10 < 8 else (f"d{i % 500}", str(i % 500)) if i % 10 < 9 else (None, None)) for i in got)
    assert "skew=true" in plan and "BroadcastExchange" not in plan
