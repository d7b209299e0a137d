"""Statistics of queries, traces, metrics and checkpoints, kept as ordinary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrain.functions import scalars as S
from vitalgrain.operators.sketches import percentile_index

#: Upper bounds of the histogram.
BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound, infinity last; one pass, whatever the number of bounds."""
    counts = [F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)]
    one = df.agg(*counts, F.count(value).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(str(i)).alias("count")) for i, b in enumerate(bounds)]
    return one.select(F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))).alias("b")).select("b.*")


def performance_report(queries: DataFrame, ms: str = "execution_time_ms", ok: str = "success") -> DataFrame:
    good = F.count_if(F.col(ok))
    one = queries.agg(
        F.count("*").alias("total"), good.alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), F.round(F.avg(F.when(F.col(ok), 100.0).otherwise(0.0)), 2).alias("success_rate"),
        F.round(F.avg(ms), 4).alias("average_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    ).withColumn("_one", F.lit(1))
    return one.join(percentile_index(queries, ms, 0.95, name="p95").withColumn("_one", F.lit(1)), "_one").drop("_one")


def by_type(queries: DataFrame, kind: str, ms: str) -> DataFrame:
    return queries.groupBy(kind).agg(F.count("*").alias("count"), F.round(F.avg(ms), 4).alias("average_ms"))


def security_summary(queries: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(F.col(c), 100.0).otherwise(0.0)), 2)
    return queries.agg(
        F.count("*").alias("total"), F.count_if("contains_phi").alias("phi_queries"), F.count_if("query_validated").alias("validated"), F.count_if("security_checks_passed").alias("passed"),
        share("contains_phi").alias("phi_rate"), share("query_validated").alias("validation_rate"), share("security_checks_passed").alias("pass_rate"),
    )


def tool_stats(steps: DataFrame, tool: str, ms: str, failed: Column) -> DataFrame:
    return steps.groupBy(tool).agg(
        F.count("*").alias("calls"), F.round(F.sum(ms), 2).alias("total_ms"), F.round(F.min(ms), 2).alias("min_ms"), F.round(F.max(ms), 2).alias("max_ms"), F.round(F.avg(ms), 4).alias("average_ms"), F.count_if(failed).alias("errors")
    )


def session_report(steps: DataFrame, session: str, tool: str, ms: str) -> DataFrame:
    """Per session: steps, the set of tools, and times."""
    return steps.groupBy(session).agg(
        F.count("*").alias("steps"), F.sort_array(F.collect_set(tool)).alias("tools"), F.round(F.sum(ms), 2).alias("total_ms"), F.round(F.avg(ms), 4).alias("average_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")
    )


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def tool_sequence(steps: DataFrame, trace: str, step: str, tool: str) -> DataFrame:
    """The ordered tools of each trace."""
    return steps.groupBy(trace).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(step, tool))), lambda x: x[tool]), ">").alias("sequence"))


def error_samples(df: DataFrame, kind: str, message: str, samples: int = 3) -> DataFrame:
    """Count per kind of error with its first distinct messages."""
    first = last_n(df.select(kind, message).distinct(), kind, [F.asc(message)], samples).groupBy(kind).agg(F.sort_array(F.collect_list(message)).alias("samples"))
    return df.groupBy(kind).agg(F.count("*").alias("count")).join(first, kind)


def checkpoint_stats(df: DataFrame) -> DataFrame:
    """Per (stage, status), per each alone, and over all: one pass with grouping sets."""
    return df.groupingSets([["pipeline_stage", "status"], ["pipeline_stage"], ["status"], []], "pipeline_stage", "status").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("count"), F.sum("records_processed").alias("processed"), F.sum("records_failed").alias("failed")
    )


def dead_letter_stats(df: DataFrame) -> DataFrame:
    return df.groupingSets([["collection_name", "operation", "status"], ["collection_name"], ["operation"], ["status"], []], "collection_name", "operation", "status").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("count"), F.sum("retry_count").alias("retries")
    )


def counters(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("events"), F.round(F.sum(value), 2).alias("total"))


def health(checks: DataFrame, ok: str) -> DataFrame:
    rate = F.avg(F.when(F.col(ok), 100.0).otherwise(0.0))
    return checks.agg(F.count("*").alias("checks"), F.round(rate, 2).alias("success_rate"), (rate >= 80).alias("healthy"))


def audit_summary(log: DataFrame, as_of: str, days: int = 7, many: int = 50) -> DataFrame:
    recent = log.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.agg(F.count("*").alias("access_events"), F.count_if(~F.col("success")).alias("failures"), F.count_if(F.col("result_count") > many).alias("high_volume"), F.count_distinct("user_id").alias("unique_users"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(line) of HELP, TYPE and value for (name, kind, help, value)."""
    lines = F.array(F.format_string("# HELP %s %s", "name", "help"), F.format_string("# TYPE %s %s", "name", "kind"), F.concat_ws(" ", "name", F.col("value").cast("string")))
    return metrics.select("name", F.posexplode(lines).alias("n", "line")).orderBy("name", "n").select("line")


def suggest_indexes(df: DataFrame, sample: int = 100, most: int = 5) -> list[str]:
    """Columns that more than half of a small sample fill, most filled first; plus patient and status together."""
    rows = df.limit(sample)
    filled = rows.agg(*(F.count(c).alias(c) for c in df.columns), F.count("*").alias("_n")).first().asDict()
    n = filled.pop("_n")
    found = [c for c, k in sorted(filled.items(), key=lambda x: (-x[1], x[0])) if k * 2 > n][:most]
    return found + (["patient_id,status"] if {"patient_id", "status"} <= set(df.columns) else [])


def schema_paths(df: DataFrame, depth: int = 3) -> DataFrame:
    """(path, type) of all columns and nested fields down to a depth, from the schema alone."""
    from pyspark.sql.types import ArrayType, StructType

    out = []

    def walk(kind, path, left):
        if isinstance(kind, ArrayType):
            kind = kind.elementType
        if isinstance(kind, StructType) and left:
            for f in kind.fields:
                name = f"{path}.{f.name}" if path else f.name
                out.append((name, f.dataType.simpleString()))
                walk(f.dataType, name, left - 1)

    walk(df.schema, "", depth)
    return df.sparkSession.createDataFrame(out, "path string, type string")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionAll, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))


def metrics_summary(df: DataFrame, ok: str, ms: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.when(F.col(ok), 100.0).otherwise(0.0)), 2).alias("success_rate"), F.round(F.avg(ms), 4).alias("average_duration"), F.count("*").alias("operations"))


def matrix_summary(runs: DataFrame, passed: Column, tool: str) -> DataFrame:
    """One row over a matrix of test runs: how many there are, passed, their share, and distinct tools."""
    return runs.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.round(F.avg(F.when(passed, 100.0).otherwise(0.0)), 2).alias("success_rate"), F.count_distinct(tool).alias("tools"))


def sampled_schema(df: DataFrame, sample: int = 100, depth: int = 3) -> DataFrame:
    """(path, types, sample_value, filled, sampled, documents) of columns and nested fields, from the first rows by all columns.

    Fields that hold JSON text show the types that their values have.
    """
    from pyspark.sql.types import ArrayType, StructType

    paths: list[tuple[str, Column]] = []

    def walk(kind, column, path, left):
        if isinstance(kind, StructType) and left:
            for f in kind.fields:
                name, inner = (f"{path}.{f.name}", column[f.name]) if path else (f.name, F.col(f"`{f.name}`"))
                paths.append((name, inner))
                walk(f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType, F.get(inner, F.lit(0)) if isinstance(f.dataType, ArrayType) else inner, name, left - 1)

    walk(df.schema, None, "", depth)
    kinds = dict(zip((p for p, _ in paths), (df.select(c.alias("c")).schema["c"].dataType.simpleString() for _, c in paths), strict=True))
    rows = df.orderBy(*df.columns).limit(sample)  # a top-k of few rows

    def kind_of(path, c):
        if kinds[path] != "string":
            return F.lit(kinds[path])
        return F.when(c.rlike(r"^\s*[\[{]"), F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("string"))).otherwise("string")

    found = F.array(*(F.struct(F.lit(p).alias("path"), F.when(c.isNotNull(), kind_of(p, c)).alias("type"), c.cast("string").alias("value")) for p, c in paths))
    seen = rows.select(F.explode(found).alias("f")).groupBy("f.path").agg(
        F.sort_array(F.collect_set("f.type")).alias("types"), F.min("f.value").alias("sample_value"), F.count("f.value").alias("filled"), F.count("*").alias("sampled")
    )
    return seen.withColumn("_one", F.lit(1)).join(F.broadcast(df.agg(F.count("*").alias("documents")).withColumn("_one", F.lit(1))), "_one").drop("_one")


# ---- state machines ----
DUE = "status IN ('pending', 'retry_scheduled') AND retry_count < max_retries"


def retry_candidates(df: DataFrame, as_of: str) -> DataFrame:
    """Entries that may be tried again now, oldest first."""
    return df.where(DUE).where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)).orderBy("created_at", "entry_id")


def resume_points(df: DataFrame, limit: int = 50) -> DataFrame:
    """Checkpoints in progress, and failed ones with tries left."""
    part = lambda cond: df.where(cond).orderBy(F.desc("start_time"), "checkpoint_id").limit(limit)
    return part("status = 'in_progress'").unionAll(part("status = 'failed' AND retry_count < 3"))


def after_failure(df: DataFrame, as_of: str) -> DataFrame:
    """The dead-letter step: entries with tries left are scheduled with a doubled delay, the others archived."""
    left = F.col("retry_count") + 1 < F.col("max_retries")
    at = F.date_format(F.to_timestamp(F.lit(as_of)) + F.make_dt_interval(secs=S.dlq_delay(F.col("retry_count"))), "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({"status": F.when(left, "retry_scheduled").otherwise("archived"), "next_retry_at": F.when(left, at), "retry_count": F.col("retry_count") + 1})


def without_old(df: DataFrame, statuses: list[str], at: str, as_of: str, days: int) -> DataFrame:
    """Retention: finished rows older than the days go."""
    old = F.col("status").isin(statuses) & (F.to_timestamp(at) < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))
    return df.where(~F.coalesce(old, F.lit(False)))
