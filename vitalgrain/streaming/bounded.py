"""Streams run to their end: micro-batches over what is there, results as a table in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from vitalgrain.streaming import stateful


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}-streams"
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex[:12]}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All results of a stream; in complete mode those of the last micro-batch."""
    spark, at, schema = stream.sparkSession, shared_folder(stream.sparkSession), stream.schema
    stream.sparkSession.createDataFrame([], schema).write.parquet(f"{at}/out")

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    stateful.run_available(stream, f"{at}/checkpoint", each, mode)
    return spark.read.schema(schema).parquet(f"{at}/out")
