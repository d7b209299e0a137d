"""Driver-side runtime: result cache, retries, cursors, catalog lookups, checkpoints and masks of plans' parameters."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.functions.errors import NotFoundError, ValidationError


def cache_key(operation: str, params: dict, role: str) -> str:
    """Hash of what a result depends on; the role is part of it, as masks differ."""
    return hashlib.sha256(json.dumps([operation, params, role], sort_keys=True, default=str).encode()).hexdigest()


class ResultCache:
    """Persisted results with a time to live and a bound on their number; the oldest go first."""

    def __init__(self, seconds: float = 1800.0, most: int = 100, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.entries: dict[str, tuple[float, str, DataFrame]] = {}

    def get(self, operation: str, params: dict, role: str, make: Callable[[], DataFrame]) -> DataFrame:
        key, now = cache_key(operation, params, role), self.clock()
        found = self.entries.get(key)
        if found and now - found[0] < self.seconds:
            return found[2]
        self._drop(key)
        while len(self.entries) >= self.most:
            self._drop(next(iter(self.entries)))
        df = make().persist()
        self.entries[key] = (now, operation, df)
        return df

    def _drop(self, key: str) -> None:
        if found := self.entries.pop(key, None):
            found[2].unpersist()

    def invalidate(self, prefix: str = "") -> int:
        """Forget the results of operations that begin so."""
        gone = [k for k, (_, operation, _) in self.entries.items() if operation.startswith(prefix)]
        for k in gone:
            self._drop(k)
        return len(gone)


def retry(f: Callable, attempts: int = 3, base: float = 1.0, strategy: str = "exponential", most: float = 60.0, jitter: float = 0.1, on: tuple = (ConnectionError, TimeoutError), sleep=time.sleep):
    """Call until it succeeds; other kinds of error aren't tried again."""
    for n in range(attempts):
        try:
            return f()
        except on:
            if n + 1 == attempts:
                raise
            wait = {"immediate": 0.0, "linear": base * (n + 1), "exponential": base * 2**n}[strategy]
            sleep(min(wait, most) * (1 + random.uniform(-jitter, jitter)))


def cursor(df: DataFrame, size: int = 1000, make: Callable | None = None) -> Iterator[list]:
    """Rows in batches, one partition at a time on the driver."""
    batch = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(make(row) if make else row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise NotFoundError(f"no table {name}", table=name)
    return spark.table(name)


def table_layout(spark: SparkSession, name: str) -> dict:
    """What serves as an index here: partition and bucket columns, format, and files."""
    rows = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE EXTENDED `{name}`").collect()}
    return {"provider": rows.get("Provider"), "buckets": rows.get("Num Buckets"), "bucket_columns": rows.get("Bucket Columns"), "sort_columns": rows.get("Sort Columns"), "files": len(spark.table(name).inputFiles())}


def column_use(log: DataFrame, columns: str = "columns", at: str = "ts") -> DataFrame:
    """(field, uses, last_used) from a log of the columns that queries filtered by: what an index on each would have served."""
    return log.select(F.explode(columns).alias("field"), F.col(at).alias("_at")).where(F.col("field").isNotNull()).groupBy("field").agg(F.count("*").alias("uses"), F.max("_at").alias("last_used"))


def include(df: DataFrame, fields: list[str], keep_id: bool = True) -> DataFrame:
    """The fields that exist, with _id unless it isn't wanted."""
    wanted = (["_id"] if keep_id and "_id" in df.columns else []) + [f for f in fields if f.split(".")[0] in df.columns and f != "_id"]
    return df.select(*(F.col(f).alias(f.split(".")[-1]) for f in wanted))


def exclude(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.drop(*fields)


def nested(df: DataFrame, path: str, default=None) -> Column:
    """A value by dotted path, or the default where the path leads nowhere."""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "names") or part not in kind.names:
            return F.lit(default)
        kind = kind[part].dataType
    return F.coalesce(F.col(path), F.lit(default)) if default is not None else F.col(path)


def listed(df: DataFrame, order: str, key: str, limit: int = 50, **equal) -> DataFrame:
    """Rows by optional equalities, newest first."""
    for field, value in equal.items():
        if value is not None:
            df = df.where(F.col(field) == value)
    return df.orderBy(F.desc(order), F.asc(key)).limit(limit)


def by_id(active: DataFrame, history: DataFrame, key: str, value) -> DataFrame:
    """One row by id, from the active ones first."""
    both = active.where(F.col(key) == value).withColumn("_n", F.lit(0)).unionByName(history.where(F.col(key) == value).withColumn("_n", F.lit(1)))
    return both.orderBy("_n").limit(1).drop("_n")


def failures(steps: DataFrame) -> DataFrame:
    """Error steps and tool calls that failed."""
    return steps.where(F.coalesce("error_message", F.col("tool_call.error")).isNotNull()).withColumn("error", F.coalesce("error_message", F.col("tool_call.error")))


#: Which states of a checkpoint follow which.
FOLLOWS = {None: {"started"}, "started": {"in_progress", "failed"}, "in_progress": {"in_progress", "completed", "failed"}, "failed": {"in_progress"}, "completed": set()}


def bad_transitions(log: DataFrame, key: str = "checkpoint_id", at: str = "at") -> DataFrame:
    """Log rows whose status can't follow the one before of the same checkpoint."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy(key).orderBy(at))
    fine = F.lit(False)
    for state, next_ in FOLLOWS.items():
        if next_:
            fine = fine | ((before.isNull() if state is None else F.coalesce(before == state, F.lit(False))) & F.col("status").isin(sorted(next_)))
    return log.withColumn("_fine", fine).where("NOT _fine").drop("_fine")


def advance(status: str | None, to: str) -> str:
    if to not in FOLLOWS[status]:
        raise ValidationError(f"{to} can't follow {status}")
    return to


def checksum(fields: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def checkpoint_key(*fields: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def common_fields(df: DataFrame, most: int = 5) -> DataFrame:
    """The columns that most rows fill, by one pass."""
    one = df.agg(*(F.count(c).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in df.columns))
    return one.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("filled"), "field").limit(most)


def expired(at: Column, as_of: str, minutes: int) -> Column:
    return at < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {minutes} MINUTES")
