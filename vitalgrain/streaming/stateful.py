"""Structured Streaming forms: micro-batches, windowed counts, dedup and the sliding rate limit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder's Parquet files as micro-batches; a single file is found in its folder by name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, one micro-batch after another, and stop; offsets survive in the checkpoint."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def windowed_counts(df: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), key, "count")


def session_counts(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("session_start"), key, "count")


def dedup(df: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First of each content within the watermark; state goes when it passes."""
    return df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def rate_limit(df: DataFrame, key: str, at: str, limit: int = 60, seconds: float = 60.0, late: str = "1 hour") -> DataFrame:
    """(key, ts, allowed): the state of a key is the times of its last allowed requests, at most ``limit``.

    The requests of a key's micro-batch are put in order over all its frames; ``maxFilesPerTrigger`` bounds
    a micro-batch. Rows that come later than ``late`` behind the newest are left out, and a key's state goes
    when the watermark has passed all its times.
    """

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames), ignore_index=True).sort_values("_at", kind="stable")
        allowed = []
        for now in frame["_at"].astype("datetime64[us]").astype("int64") / 1e6:
            seen = [t for t in seen if now - t < seconds]
            allowed.append(len(seen) < limit)
            if allowed[-1]:
                seen.append(now)
        state.update((seen,))
        if seen:
            state.setTimeoutTimestamp(max(int((seen[-1] + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])] * len(frame), "ts": frame[at].to_numpy(), "allowed": allowed})

    timed = df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(key).applyInPandasWithState(step, "key string, ts timestamp_ntz, allowed boolean", "seen array<double>", "append", GroupStateTimeout.EventTimeTimeout)
