"""User aggregates in partial and final form, and table functions over partitioned input.

An ``Aggregate`` is four functions over a state that can be written as JSON. Tasks fold what they have read into states
per key, so a hot key crosses the shuffle as a row per task (or per ``FLUSH`` keys), and the states of a key are merged as a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

FLUSH = 50_000  # keys that a task holds


@dataclass(frozen=True)
class Aggregate:
    """zero() -> state, add(state, value) -> state, merge(state, state) -> state, finish(state) -> result of the type ``kind``."""

    zero: Callable[[], Any]
    add: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    kind: str


def user_aggregate(df: DataFrame, keys: list[str], value: str, agg: Aggregate, name: str) -> DataFrame:
    """(keys, ``name``): the aggregate of each group's values, nulls left out; a null key is a group, one without values has the zero's result."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*(df.schema[k] for k in keys), StructField("_state", StringType())])
    result = StructType([*(df.schema[k] for k in keys), *StructType.fromDDL(f"`{name}` {agg.kind}").fields])
    partial_kind, result_kind = to_arrow_schema(schema), to_arrow_schema(result)

    def batch_of(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], kind.names)

    def partial(batches):
        states: dict[tuple, Any] = {}
        for batch in batches:
            for *key, v in zip(*(batch.column(c).to_pylist() for c in range(len(keys) + 1)), strict=True):
                at = tuple(key)
                state = states[at] if at in states else agg.zero()
                states[at] = state if v is None else agg.add(state, v)
            if len(states) > FLUSH:
                yield batch_of([(*k, json.dumps(s)) for k, s in states.items()], partial_kind)
                states = {}
        if states:
            yield batch_of([(*k, json.dumps(s)) for k, s in states.items()], partial_kind)

    def final(batches):
        last, state, made = None, None, []
        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in range(len(keys) + 1)), strict=True):
                if last != key:
                    if last is not None:
                        made.append((*last, agg.finish(state)))
                    last, state = key, agg.zero()
                state = agg.merge(state, json.loads(text))
            if made:
                yield batch_of(made, result_kind)
                made = []
        if last is not None:
            yield batch_of([(*last, agg.finish(state))], result_kind)

    named = [F.col(f"`{k}`") for k in keys]
    states = df.select(*named, F.col(f"`{value}`")).mapInArrow(partial, schema)
    return states.repartition(*named).sortWithinPartitions(*named).mapInArrow(final, result)


def _moments_merge(a, b):
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return [n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n]


#: Population variance by merged moments: count, mean, sum of squares around it.
VARIANCE = Aggregate(lambda: [0, 0.0, 0.0], lambda s, v: _moments_merge(s, [1, float(v), 0.0]), _moments_merge, lambda s: s[2] / s[0] if s[0] else None, "double")


class Sessions:
    """Sessions of each user: a pause over ``gap`` seconds ends one. Rows come by user and time, whatever the caller's table is."""

    @staticmethod
    def analyze(table: AnalyzeArgument, user: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name: f.dataType for f in table.dataType.fields}
        for column in (user.value, at.value):
            if column not in names:
                raise ValueError(f"the table has no column {column}")
        if gap.value is None or gap.value <= 0:
            raise ValueError("the gap has to be more than 0 seconds")
        schema = StructType([StructField("user", names[user.value]), StructField("session", LongType()), StructField("start", TimestampNTZType()), StructField("end", TimestampNTZType()), StructField("n", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{user.value}`")], orderBy=[OrderingColumn(f"`{at.value}`")])

    def __init__(self):
        self.user, self.number, self.start, self.end, self.n = None, 0, None, None, 0

    def eval(self, row, user: str, at: str, gap: float):
        now = row[at]
        if now is None:
            return
        self.user = row[user]
        if self.n and (now - self.end).total_seconds() > gap:
            yield self._made()
            self.n = 0
        if not self.n:
            self.number, self.start = self.number + 1, now
        self.end, self.n = now, self.n + 1

    def terminate(self):
        if self.n:
            yield self._made()

    def _made(self):
        return self.user, self.number, self.start, self.end, self.n


def register_functions(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("sessions_of", udtf(Sessions))


def sessions(df: DataFrame, user: str, at: str, gap: float) -> DataFrame:
    """(user, session, start, end, n) by the table function."""
    return udtf(Sessions)(df.asTable(), F.lit(user), F.lit(at), F.lit(float(gap)))
