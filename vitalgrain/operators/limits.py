"""Order-dependent folds: the sliding rate limit and the circuit breaker, exact and in batch form.

Both fold the ordered events of one key. Keys are independent; one key's events pass through a task
as a stream in order, with a state of at most the limit, never as a whole.

For hot keys there are forms by time blocks. Counting copies the last window of each block to the next one (its halo).
The folds hand their state over: every block is folded from an empty state, then each block whose predecessor
ends in another state than was assumed is folded again, until no state changes; at last all rows are folded
once from the states found. A block that the state before doesn't reach (a pause as long as the window, a success that closes a
breaker) ends a chain, so rounds are few; at worst there are as many as a key has blocks.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrain.streaming.bounded import shared_folder


def requests_in_window(df: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """How many requests of the key, this one included, lie in the window behind each."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return df.withColumn("in_window", F.count("*").over(Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)))


def requests_in_blocks(df: DataFrame, key: str, at: str, seconds: int = 60, windows: int = 60) -> DataFrame:
    """``requests_in_window`` by blocks of ``windows`` windows: a hot key is as many tasks as it has blocks; rows without a time have no count."""
    wide, width = seconds * 1_000_000, seconds * windows * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = df.withColumns({"_micros": micros, "_block": F.floor(micros / width)})
    # a row in the last window of a block is seen from the next one
    blocks = F.when(F.floor((F.col("_micros") + wide - 1) / width) > F.col("_block"), F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    copied = timed.withColumn("_seen", F.explode(blocks))
    by = Window.partitionBy(key, "_seen").orderBy("_micros").rangeBetween(-(wide - 1), 0)
    counted = copied.withColumn("in_window", F.when(F.col("_micros").isNotNull(), F.count("*").over(by))).where(F.col("_seen").eqNullSafe(F.col("_block")))
    return counted.drop("_micros", "_block", "_seen")


def _fold(df: DataFrame, key: str, order: list[str], schema: str, start, step) -> DataFrame:
    """Run ``step(state, row) -> (state, value)`` over each key's rows in order, streaming through sorted partitions."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    out_schema = StructType(df.schema.fields + new.fields)
    kind = to_arrow_type(new.fields[0].dataType)

    def run(batches):
        last, state = object(), None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, new.fields[0].name])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out_schema)


def rate_limit(df: DataFrame, key: str, at: str, limit: int = 60, seconds: float = 60.0, tie: str | None = None) -> DataFrame:
    """Adds ``allowed``: fewer than ``limit`` allowed requests lie within the seconds before. Refused ones don't count."""

    def step(seen: deque, row):
        now = row[at].timestamp()
        while seen and now - seen[0] >= seconds:
            seen.popleft()
        if len(seen) >= limit:
            return seen, False
        seen.append(now)
        return seen, True

    return _fold(df, key, [at, *([tie] if tie else [])], "allowed boolean", deque, step)


#: (state, failures in a row, probes won, probes lost, when it opened or last failed) of a breaker at rest.
CLOSED = ("closed", 0, 0, 0, 0)


def breaker_step(s: tuple, now: int, ok: bool, failures: int, rest: int, probes: int, losses: int) -> tuple[tuple, str]:
    """What a call at ``now`` makes of a breaker, and the state that it met."""
    state, failed, won, lost, since = s
    if state == "open" and now - since >= rest:
        state, won, lost = "half_open", 0, 0
    met = state
    if state == "closed":
        failed = 0 if ok else failed + 1
        if failed >= failures:
            state, since = "open", now
    elif state == "half_open":
        won, lost = won + ok, lost + (not ok)
        if lost >= losses:
            state, since = "open", now
        elif won >= probes:
            return CLOSED, met
    return (state, failed, won, lost, since), met


def circuit_breaker(df: DataFrame, key: str, at: str, ok: str, failures: int = 5, rest: float = 60.0, probes: int = 3, losses: int = 1, tie: str | None = None) -> DataFrame:
    """Adds ``state`` that each call met: closed, open or half_open.

    Failures in a row open it; after the rest calls are let through to probe: ``probes`` successes close it,
    ``losses`` failures open it again. Calls that meet it open aren't made and change nothing.
    """

    def step(s, row):
        return breaker_step(s, round(row[at].timestamp() * 1e6), row[ok], failures, int(rest * 1e6), probes, losses)

    return _fold(df, key, [at, *([tie] if tie else [])], "state string", lambda: CLOSED, step)


def _fold_blocks(df: DataFrame, key: str, at: str, tie: str, fact: str | None, out: str, kind: str, seconds: float, start, step, settle) -> DataFrame:
    """``step(state, micros, fact) -> (state, value)`` over each key's rows in order, by time blocks of ``seconds``.

    ``settle(state, end)`` is what is left of a state at the end of its block; states are JSON. Rows without a time
    change nothing and get no value.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    spark, width, folder = df.sparkSession, int(seconds * 1_000_000), shared_folder(df.sparkSession)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.select(F.col(key).alias("k"), F.floor(micros / width).alias("block"), micros.alias("micros"), F.col(tie).alias("tie"), (F.col(fact) if fact else F.lit(None).cast("boolean")).alias("fact"))
    rows.where("micros IS NOT NULL").write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    key_type, tie_type = rows.schema["k"].dataType, rows.schema["tie"].dataType
    blocks = rows.select("k", "block").distinct().withColumn("before", F.lag("block").over(Window.partitionBy("k").orderBy("block")))
    states_type = StructType([StructField("k", key_type), *StructType.fromDDL("block long, state string").fields])
    values_type = StructType([StructField("k", key_type), StructField("tie", tie_type), *StructType.fromDDL(f"value {kind}").fields])
    value_kind = to_arrow_type(values_type["value"].dataType)

    def passed(some: DataFrame, given: DataFrame, whole: bool) -> DataFrame:
        """End states of blocks, or values of their rows; ``given``: states at the beginning of some."""

        def run(batches):
            last, state, ends, values = None, None, [], []

            def close():
                if state is not None and not whole:
                    ends.append((last[0], last[1], json.dumps(settle(state, (last[1] + 1) * width))))

            for batch in batches:
                for k, block, held, t, n, x in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "state", "micros", "tie", "fact")), strict=True):
                    if (k, block) != last:
                        close()
                        last, state = (k, block), start()
                    if held is not None:
                        state = json.loads(held)
                        continue
                    state, value = step(state, t, x)
                    if whole:
                        values.append((k, n, value))
                if whole and values:
                    k, n, v = zip(*values, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, to_arrow_type(key_type)), pa.array(n, to_arrow_type(tie_type)), pa.array(v, value_kind)], values_type.names)
                    values.clear()
            close()
            if ends:
                k, b, s = zip(*ends, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, to_arrow_type(key_type)), pa.array(b, pa.int64()), pa.array(s, pa.string())], states_type.names)

        order = ["k", "block", F.desc_nulls_last("state"), "micros", "tie"]  # the given state goes first
        both = some.withColumn("state", F.lit(None).cast("string")).unionByName(given, allowMissingColumns=True)
        return both.repartition("k", "block").sortWithinPartitions(*order).mapInArrow(run, values_type if whole else states_type)

    def saved(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    chain = saved(blocks, "chain")
    same = lambda a, b: a.eqNullSafe(b)
    nothing = spark.createDataFrame([], states_type)
    ends = saved(passed(rows, nothing, False), "ends-0")
    assumed = saved(chain.select("k", "block", F.lit(json.dumps(start())).alias("state")), "assumed-0")
    turn = 0
    while True:
        turn += 1
        a, b = chain.alias("a"), ends.alias("b")
        found = a.join(b, same(F.col("a.k"), F.col("b.k")) & (F.col("a.before") == F.col("b.block"))).select("a.k", "a.block", "b.state")
        c = assumed.alias("c")
        changed = saved(
            found.alias("d").join(c, same(F.col("d.k"), F.col("c.k")) & (F.col("d.block") == F.col("c.block")) & (F.col("d.state") != F.col("c.state"))).select("d.k", "d.block", "d.state"), f"changed-{turn}"
        )
        if not changed.limit(1).count():
            break
        only = lambda frame, how: frame.alias("x").join(changed.alias("y"), same(F.col("x.k"), F.col("y.k")) & (F.col("x.block") == F.col("y.block")), how)  # noqa: E731, B023
        again = passed(only(rows, "left_semi"), changed, False)
        ends = saved(only(ends, "left_anti").union(again), f"ends-{turn}")
        assumed = saved(only(assumed, "left_anti").union(changed), f"assumed-{turn}")
    values = passed(rows, assumed.where(F.col("state") != json.dumps(start())), True)
    return df.alias("x").join(values.alias("v"), same(F.col(f"x.{key}"), F.col("v.k")) & (F.col(f"x.{tie}") == F.col("v.tie")), "left").select("x.*", F.col("v.value").alias(out))


def rate_limit_blocks(df: DataFrame, key: str, at: str, tie: str, limit: int = 60, seconds: float = 60.0, windows: int = 60) -> DataFrame:
    """``rate_limit`` for hot keys; ``tie`` tells the rows of a key apart."""
    wide = int(seconds * 1_000_000)

    def step(seen, now, _):
        seen = [t for t in seen if now - t < wide]
        return (seen, False) if len(seen) >= limit else ([*seen, now], True)

    return _fold_blocks(df, key, at, tie, None, "allowed", "boolean", seconds * windows, list, step, lambda seen, end: [t for t in seen if end - t < wide])


def circuit_breaker_blocks(df: DataFrame, key: str, at: str, ok: str, tie: str, failures: int = 5, rest: float = 60.0, probes: int = 3, losses: int = 1, seconds: float = 3600.0) -> DataFrame:
    """``circuit_breaker`` for hot keys, by blocks of ``seconds``; ``tie`` tells the rows of a key apart."""

    def step(s, now, good):
        return breaker_step(s, now, good, failures, int(rest * 1e6), probes, losses)

    def settle(s, _):
        state, failed, won, lost, since = s
        return {"closed": (state, failed, 0, 0, 0), "open": (state, 0, 0, 0, since), "half_open": (state, 0, won, lost, 0)}[state]

    return _fold_blocks(df, key, at, tie, ok, "state", "string", seconds, lambda: CLOSED, step, settle)


def sessions_expired(df: DataFrame, key: str, at: str, address: str, minutes: int = 30) -> DataFrame:
    """Adds whether a request meets an expired session or one from another address."""
    by = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(by).cast("timestamp"))
    return df.withColumn("expired", F.coalesce(gap > minutes * 60_000_000, F.lit(False))).withColumn("moved", F.coalesce(F.col(address) != F.first(address).over(by), F.lit(False)))
