"""State machines over ``events`` as a stream that arrives in pieces and out of order, with recursive SQL twins.

The table is written as files in two runs, each row up to a day after its turn; each run goes on from the checkpoint
of the one before. The last piece comes with the row that ends the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.sources.entities import read_table
from vitalgrain.streaming import bounded, machines, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PIECES, DELAY = 2, 86_400


def arriving(events: DataFrame, folder: str, pieces: int = PIECES):
    """Write the rows piece by piece, a row up to ``DELAY`` seconds after its turn; yields after each piece."""
    spark = events.sparkSession
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros), F.max(micros)).head()
    if first is None:
        return
    width = max(1, -(-(last - first + 1) // pieces))
    piece = F.least(F.floor((micros - first + F.pmod(F.xxhash64("event_id"), F.lit(DELAY)) * 1_000_000) / width), F.lit(pieces - 1))
    for i in range(pieces):
        events.where(piece == i).write.mode("append").parquet(folder)
        if i == pieces - 1:
            machines.close(spark, folder, events.schema, "ts")
        yield i


def transitions(spark: SparkSession, sf_dir: str, machine: machines.Machine, what, more="") -> DataFrame:
    """All transitions of a machine per user of ``events``."""
    events, at = read_table(spark, sf_dir, "events"), bounded.shared_folder(spark)
    kind = spark.createDataFrame([], machines.OUT).schema
    for _ in arriving(events, f"{at}/in"):
        stream = stateful.file_stream(spark, f"{at}/in", events.schema, files_per_trigger=10_000)
        machines.run(machines.transitions(stream, machine, "user_id", "ts", "event_id", what, more, "2 days"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(kind).parquet(f"{at}/out") if machines.written(spark, f"{at}/out") else spark.createDataFrame([], kind)


def add(name: str, machine: Callable[[], machines.Machine], what: Callable, sql: str, more: Callable = lambda: "") -> None:
    QUERIES[name] = lambda spark, sf_dir: transitions(spark, sf_dir, machine(), what(), more())
    SQL[name] = sql


def mapped(**kinds: str):
    """The event type under a machine's words."""
    out = F.lit("other")
    for kind, word in kinds.items():
        out = F.when(F.col("event_type") == kind, word).otherwise(out)
    return out


def _rows(what: str, more: str = "''") -> str:
    return f"WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS t, {what} AS what, {more} AS more, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "


add(
    "stm03_circuit_breaker_stream", lambda: machines.Breaker(2, 36_000.0, 1, 3), lambda: F.when(F.col("event_type") == "error", "failed").otherwise("ok"),
    _rows("event_type <> 'error'") + """f AS (
      SELECT CAST(0 AS BIGINT) AS n, key, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS t, '' AS met, 'closed' AS state, 0 AS failed, 0 AS lost, CAST(0 AS BIGINT) AS since FROM e WHERE n = 1
      UNION ALL SELECT e.n, e.key, e.event_id, e.t, m.met,
        CASE WHEN m.met = 'closed' AND NOT e.what AND f.failed + 1 >= 2 OR m.met = 'half_open' AND NOT e.what AND m.lost + 1 >= 3 THEN 'open' WHEN m.met = 'half_open' AND e.what THEN 'closed' ELSE m.met END,
        CASE WHEN m.met = 'closed' AND NOT e.what THEN f.failed + 1 WHEN m.met = 'open' OR m.met = 'half_open' AND NOT e.what THEN f.failed ELSE 0 END,
        CASE WHEN m.met = 'half_open' AND NOT e.what THEN m.lost + 1 ELSE m.lost END,
        CASE WHEN NOT e.what AND (m.met = 'closed' AND f.failed + 1 >= 2 OR m.met = 'half_open' AND m.lost + 1 >= 3) THEN e.t ELSE f.since END
      FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1,
        LATERAL (SELECT CASE WHEN f.state = 'open' AND e.t - f.since >= 36000000000 THEN 'half_open' ELSE f.state END AS met, CASE WHEN f.state = 'open' AND e.t - f.since >= 36000000000 THEN 0 ELSE f.lost END AS lost) m
    ) SELECT key, event_id AS tie, t AS micros, met AS what FROM f WHERE n > 0""",
)

# a session lasts two days; an address stays for a stretch of events
_SESSION = "CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' ELSE 'request' END"
add(
    "stm07_sessions_stream", lambda: machines.Session(172_800.0), lambda: mapped(signup="login", error="logout", click="request", view="request", purchase="request"),
    _rows(_SESSION, "CAST(event_id // 1000 % 2 AS VARCHAR)") + """f AS (
      SELECT CAST(0 AS BIGINT) AS n, key, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS word, CAST(NULL AS BIGINT) AS since, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS BIGINT) AS over FROM e WHERE n = 1
      UNION ALL SELECT e.n, e.key, e.event_id, e.t, w.word, CASE WHEN w.word = 'created' THEN e.t WHEN w.word = 'valid' THEN f.since END, CASE WHEN w.word = 'created' THEN e.more WHEN w.word = 'valid' THEN f.address END,
        CASE WHEN NOT o.there AND f.since IS NOT NULL THEN f.since + 172800000001 END
      FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1, LATERAL (SELECT coalesce(e.t - f.since <= 172800000000, false) AS there) o,
        LATERAL (SELECT CASE WHEN e.what = 'login' THEN 'created' WHEN NOT o.there THEN 'unknown' WHEN e.what = 'logout' THEN 'revoked' WHEN e.more = f.address THEN 'valid' ELSE 'moved' END AS word) w
    ), last AS (SELECT key, since FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
    SELECT key, event_id AS tie, t AS micros, word AS what FROM f WHERE n > 0 UNION ALL SELECT key, NULL, over AS micros, 'expired' FROM f WHERE over IS NOT NULL UNION ALL SELECT key, NULL, since + 172800000001, 'expired' FROM last WHERE since IS NOT NULL""",
    lambda: F.floor(F.col("event_id") / 1000) % 2,
)

add(
    "stm05_dead_letters_stream", lambda: machines.DeadLetter(4, 43_200.0), lambda: mapped(error="failed", purchase="retried", signup="resolved"),
    _rows("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'retried' WHEN 'signup' THEN 'resolved' END") + """f AS (
      SELECT CAST(0 AS BIGINT) AS n, key, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS word, CAST(NULL AS VARCHAR) AS status, 0 AS tries, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS fell FROM e WHERE n = 1
      UNION ALL SELECT e.n, e.key, e.event_id, e.t, w.word, CASE WHEN w.word IS NULL THEN f.status WHEN w.word IN ('pending', 'retry_scheduled') THEN w.word END,
        CASE WHEN w.word IS NULL THEN f.tries WHEN w.word = 'retry_scheduled' THEN f.tries + 1 ELSE 0 END,
        CASE WHEN w.word = 'retry_scheduled' THEN e.t + 43200000000 * (1 << f.tries) WHEN w.word IS NULL AND f.due > e.t THEN f.due END, CASE WHEN f.due <= e.t THEN f.due END
      FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1,
        LATERAL (SELECT CASE WHEN e.what = 'failed' THEN CASE WHEN f.status IS NULL THEN 'pending' WHEN f.tries + 1 < 4 THEN 'retry_scheduled' ELSE 'archived' END WHEN f.status IS NOT NULL THEN e.what END AS word) w
    ), last AS (SELECT key, due FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
    SELECT key, event_id AS tie, t AS micros, word AS what FROM f WHERE n > 0 AND word IS NOT NULL UNION ALL SELECT key, NULL, fell, 'due' FROM f WHERE fell IS NOT NULL UNION ALL SELECT key, NULL, due, 'due' FROM last WHERE due IS NOT NULL""",
)

add(
    "stm06_checkpoints_stream", lambda: machines.Checkpoint(129_600.0), lambda: mapped(signup="started", click="in_progress", view="in_progress", purchase="completed", error="failed"),
    _rows("CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END") + """f AS (
      SELECT CAST(0 AS BIGINT) AS n, key, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS word, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS over FROM e WHERE n = 1
      UNION ALL SELECT e.n, e.key, e.event_id, e.t, CASE WHEN o.fits THEN e.what ELSE 'refused' END, CASE WHEN o.fits THEN nullif(e.what, 'completed') ELSE p.status END, CASE WHEN o.fits THEN CASE WHEN e.what <> 'completed' THEN e.t END WHEN p.status IS NOT NULL THEN f.since END,
        CASE WHEN f.since + 129600000000 <= e.t THEN f.since + 129600000000 END
      FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1, LATERAL (SELECT CASE WHEN f.since + 129600000000 <= e.t THEN NULL ELSE f.status END AS status) p,
        LATERAL (SELECT coalesce(p.status, '') || '>' || e.what IN ('>started', 'started>in_progress', 'started>failed', 'in_progress>in_progress', 'in_progress>completed', 'in_progress>failed', 'failed>in_progress') AS fits) o
    ), last AS (SELECT key, since FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
    SELECT key, event_id AS tie, t AS micros, word AS what FROM f WHERE n > 0 UNION ALL SELECT key, NULL, over AS micros, 'expired' FROM f WHERE over IS NOT NULL UNION ALL SELECT key, NULL, since + 129600000000, 'expired' FROM last WHERE since IS NOT NULL""",
)
