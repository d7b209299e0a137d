"""State machines over streams: circuit breakers, sessions, dead letters, checkpoints and rate limits, in event-time order.

``transformWithState`` runs a machine per key. Rows wait in list state until the watermark has passed them, then go
through the machine by (time, tie), so what a stream gives doesn't depend on the order in which files arrive. What a
machine does by itself at a time (a session expires, a retry falls due) happens in between, by an event-time timer. State
of a key goes when the machine is at rest and nothing waits.

Results are rows (key, tie, micros, what): what each row met or did, and with a null tie what happened by time. They go to a
Parquet sink with a commit log, so a stream that is stopped or fails goes on from its checkpoint without losing or
repeating rows. Rows later than the watermark are left out and counted (``Run.late``); rows without a key or time take no part.

A file stream's last rows wait for a watermark that no further row moves; ``close`` ends a stream by one row of a far time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vitalgrain.operators import limits
from vitalgrain.operators.runtime import FOLLOWS

OUT = "key string, tie long, micros long, what string"
FAR_MS = 253_370_764_800_000  # the year 9999
_WAITING = "at long, tie long, what string, more string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """Puts a key's rows in order for ``step``; times are in microseconds.

    A machine says its ``state`` columns, how it starts, what a row makes of a state (``step`` returns the new
    state and what to say), when something happens by itself (``due``) and what then does (``expire``).
    """

    state = ""

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, at: int, what: str, more: str) -> tuple[tuple, str | None]:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple) -> tuple[tuple, str | None]:
        return state, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("machine", self.state)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.appendValue((r.at, r.tie, r.what, r.more))
            first = r.at if first is None else min(first, r.at)
        if key[0] is not None and first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        else:
            self.waiting.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        state = tuple(self.held.get()) if self.held.exists() else self.start()
        said, kept = [], []
        for at, tie, what, more in rows:
            if at >= passed:
                kept.append((at, tie, what, more))
                continue
            state = self._until(state, at, said)
            state, word = self.step(state, at, what, more)
            if word is not None:
                said.append((tie, at, word))
        state = self._until(state, passed - 1, said)
        if state == self.start():
            self.held.clear()
        else:
            self.held.update(state)
        if kept:
            self.waiting.put(kept)
        else:
            self.waiting.clear()
        later = [t for t in (kept[0][0] if kept else None, self.due(state)) if t is not None]
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        return iter([Row(key=str(key[0]), tie=tie, micros=at, what=word) for tie, at, word in said])

    def _until(self, state: tuple, at: int, said: list) -> tuple:
        """What happens by itself up to a time."""
        while (due := self.due(state)) is not None and due <= at:
            state, word = self.expire(state)
            if word is not None:
                said.append((None, due, word))
        return state

    def close(self) -> None:
        pass


class Breaker(Machine):
    """Says the state that each call met; ``what`` is "ok" or anything else for a failure."""

    state = "state string, failed long, won long, lost long, since long"

    def __init__(self, failures: int = 5, rest: float = 60.0, probes: int = 1, losses: int = 3):
        self.failures, self.rest, self.probes, self.losses = failures, int(rest * 1e6), probes, losses

    def start(self) -> tuple:
        return limits.CLOSED

    def step(self, state, at, what, more):
        return limits.breaker_step(state, at, what == "ok", self.failures, self.rest, self.probes, self.losses)


class Session(Machine):
    """"login" opens a session from an address (``more``), which "logout", its time and another address end.

    Says created, valid, moved (and revoked), unknown for rows, and expired when its time is over.
    """

    state = "since long, address string"

    def __init__(self, seconds: float = 1800.0):
        self.seconds = int(seconds * 1e6)

    def start(self) -> tuple:
        return None, None

    def step(self, state, at, what, more):
        since, address = state
        if what == "login":
            return (at, more), "created"
        if since is None:
            return state, "unknown"
        if what == "logout":
            return self.start(), "revoked"
        return (state, "valid") if address == more else (self.start(), "moved")

    def due(self, state):
        return None if state[0] is None else state[0] + self.seconds + 1  # a session of just that age is valid

    def expire(self, state):
        return self.start(), "expired"


class DeadLetter(Machine):
    """"failed" adds an entry and then counts its tries, "retried", "resolved" and "archived" end it.

    Says the entry's status, and due when a scheduled try falls due. The wait doubles with each try.
    """

    state = "status string, tries long, next long"

    def __init__(self, most: int = 3, base: float = 300.0):
        self.most, self.base = most, int(base * 1e6)

    def start(self) -> tuple:
        return None, 0, None

    def step(self, state, at, what, more):
        status, tries, _ = state
        if what == "failed":
            if status is None:
                return ("pending", 0, None), "pending"
            if tries + 1 < self.most:
                return ("retry_scheduled", tries + 1, at + self.base * 2**tries), "retry_scheduled"
            return self.start(), "archived"
        if what in ("retried", "resolved", "archived") and status is not None:
            return self.start(), what
        return state, None

    def due(self, state):
        return state[2]

    def expire(self, state):
        return (state[0], state[1], None), "due"


class Checkpoint(Machine):
    """Statuses that can follow the one before are taken over, others refused; one without news for ``seconds`` is expired."""

    state = "status string, since long"

    def __init__(self, seconds: float = 86_400.0):
        self.seconds = int(seconds * 1e6)

    def start(self) -> tuple:
        return None, None

    def step(self, state, at, what, more):
        if what not in FOLLOWS[state[0]]:
            return state, "refused"
        return (self.start() if what == "completed" else (what, at)), what  # a completed one's key is free again

    def due(self, state):
        return None if state[1] is None else state[1] + self.seconds

    def expire(self, state):
        return self.start(), "expired"


class RateLimit(Machine):
    """Says allowed or refused; the state is the times of the last allowed requests, at most ``most``."""

    state = "seen array<long>"

    def __init__(self, most: int = 60, seconds: float = 60.0):
        self.most, self.seconds = most, int(seconds * 1e6)

    def start(self) -> tuple:
        return ([],)

    def step(self, state, at, what, more):
        seen = [t for t in state[0] if at - t < self.seconds]
        return (([*seen, at],), "allowed") if len(seen) < self.most else ((seen,), "refused")

    def due(self, state):
        return state[0][-1] + self.seconds if state[0] else None

    def expire(self, state):
        return self.start(), None


def transitions(stream: DataFrame, machine: Machine, key: str, at: str, tie: str, what, more="", late: str = "1 day") -> DataFrame:
    """(key, tie, micros, what) of a machine over a stream; ``what`` and ``more`` are columns of its input."""
    time = F.col(at).cast("timestamp")
    rows = stream.where(time.isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), F.unix_micros(time).alias("at"), (F.lit(what) if isinstance(what, str) else what).alias("what"),
        (F.lit(more) if isinstance(more, str) else more).cast("string").alias("more"), time.alias("_time"),
    )
    return rows.withWatermark("_time", late).groupBy("key").transformWithState(machine, OUT, "Append", "eventTime")


@dataclass
class Run:
    """What a run of a stream has done."""

    rows: int
    late: int


def run(out: DataFrame, path: str, checkpoint: str) -> Run:
    """Process what is there, from where the checkpoint stands, into the Parquet table at ``path``."""
    spark = out.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _PROVIDER)  # list state and timers need it
    try:
        query = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    done = query.recentProgress
    return Run(sum(p["numInputRows"] for p in done), sum(s["numRowsDroppedByWatermark"] for p in done for s in p["stateOperators"]))


def close(spark: SparkSession, folder: str, schema, at: str) -> None:
    """Put a row of a far time and no key into a stream's folder, so that the watermark passes all others."""
    far = F.timestamp_millis(F.lit(FAR_MS)).cast(schema[at].dataType)
    spark.range(1).select(*(far.alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)).write.mode("append").parquet(folder)


def written(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
