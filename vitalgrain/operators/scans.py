"""Running sums and numbering without a task per key: a two-level prefix scan over ranges of (key, order).

1. Rows are dealt by ranges of key and order, so a hot key spreads over as many tasks as its rows need, and each task
   adds up its own part of each key as a stream.
2. A range begins in at most one key that the range before has begun, so what is carried over is a row per range: the
   last key's totals. An exclusive scan over these rows (at most as many as there are ranges) gives the offsets.
3. The offsets, of that bounded size, are broadcast and added.

The first pass is written to the shared folder: the ranges' bounds come from a sample that another run would draw anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vitalgrain.streaming.bounded import shared_folder

#: Names of the helper columns.
RANGE, SPOT, NUMBER = "_range", "_spot", "_number"


def prefix_scan(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, number: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``number``, the place of each row among its key's rows in ``order`` (from 1), and running sums, each row included.

    ``sums`` names columns of doubles; nulls add nothing. ``order`` has to tell rows of a key apart, else ties fall as
    they come. Null keys are one key, as in a window; nulls in ``order`` go first.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    spark = df.sparkSession
    sums = sums or {}
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(sums)
    kept = [f for f in df.schema.fields if f.name not in names]
    own = [StructField(f"_sum{i}", DoubleType()) for i in range(len(names))]
    inputs = df.select(*(F.col(f"`{f.name}`") for f in kept), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_sum{i}") for i, c in enumerate(sums.values())))
    schema = StructType([*kept, *own, StructField(NUMBER, LongType()), StructField(RANGE, LongType()), StructField(SPOT, LongType())])

    def local(batches):
        part, spot, last, carried = TaskContext.get().partitionId(), 0, None, np.zeros(len(own) + 1)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(key).to_pylist()
            starts = [0] + [i for i in range(1, size) if keys[i] != keys[i - 1]]
            if spot and keys[0] != last:
                carried[:] = 0
            lengths = np.diff([*starts, size])
            made = []
            for j in range(len(own) + 1):
                values = np.ones(size) if j == len(own) else batch.column(f"_sum{j}").to_numpy(zero_copy_only=False)
                run = np.cumsum(values)
                base = np.concatenate([[0.0], run[np.array(starts[1:], int) - 1]]) if len(starts) > 1 else np.zeros(1)
                base[0] -= carried[j]
                run = run - np.repeat(base, lengths)
                carried[j] = run[-1]
                made.append(run)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(r) for r in made[:-1]]
            arrays += [pa.array(made[-1].astype(np.int64)), pa.array(np.full(size, part)), pa.array(np.arange(spot, spot + size))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
            spot, last = spot + size, keys[-1]

    by = [F.asc_nulls_first(key), *(F.asc_nulls_first(c) for c in order)]
    at = f"{shared_folder(spark)}/ranges"
    inputs.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(local, schema).write.parquet(at)
    ranged = spark.read.schema(schema).parquet(at)
    totals = F.struct(F.col(key).alias("key"), *(F.col(f.name) for f in own), F.col(NUMBER))
    ends = ranged.groupBy(RANGE).agg(F.min_by(F.struct(F.col(key).alias("key")), SPOT).alias("first"), F.max_by(totals, SPOT).alias("last")).collect()
    offsets, carry = [], None
    for r in sorted(ends, key=lambda r: r[RANGE]):  # a row per range
        begun = carry is not None and carry[0] == r.first.key
        if begun:
            offsets.append((r[RANGE], *carry))
        whole = r.first.key == r.last.key
        carry = (r.last.key, *(x + (y if begun and whole else 0) for x, y in zip(r.last[1:], carry[1:] if begun else [0] * len(r.last[1:]), strict=True)))
    kind = StructType([StructField("_r", LongType()), StructField("_k", df.schema[key].dataType), *(StructField(f"_o{i}", DoubleType()) for i in range(len(own))), StructField("_n", LongType())])
    more = F.broadcast(spark.createDataFrame(offsets, kind))
    joined = ranged.join(more, (F.col(RANGE) == F.col("_r")) & F.col(f"`{key}`").eqNullSafe(F.col("_k")), "left")
    out = [F.col(f"`{f.name}`") for f in kept if f.name != number]
    out += [(F.col(f"_sum{i}") + F.coalesce(F.col(f"_o{i}"), F.lit(0.0))).alias(name) for i, name in enumerate(names)]
    return joined.select(*out, *([(F.col(NUMBER) + F.coalesce("_n", F.lit(0))).alias(number)] if number else []))


def running_mean(df: DataFrame, kind: str, order: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Adds ``running_mean``: the mean of the kind's values up to and with each row; nulls don't count."""
    scanned = prefix_scan(df, kind, order, {"_total": F.col(value), "_known": F.when(F.col(value).isNotNull(), 1.0)}, ranges=ranges)
    return scanned.withColumn("running_mean", F.when(F.col("_known") > 0, F.col("_total") / F.col("_known"))).drop("_total", "_known")


def flushes(df: DataFrame, key: str, order: list[str], size: int = 10, ranges: int | None = None) -> DataFrame:
    """Adds ``flush``: the number of the flush that takes a key's operation, when every ``size`` of them are flushed."""
    return prefix_scan(df, key, order, number="_place", ranges=ranges).withColumn("flush", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def numbered_steps(df: DataFrame, trace: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``step``: the place of each row in its trace, from 1."""
    return prefix_scan(df, trace, order, number="step", ranges=ranges)
