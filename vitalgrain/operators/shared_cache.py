"""Results kept in the shared folder for every session: under what was asked, its plan, and the state of the files that it reads.

A result's folder is named after the operation and a digest of (operation, parameters, role, optimised plan, input files with sizes and
times), so another session finds it and a changed table misses. One writer makes a result: who first creates the claim file; others
wait for the result and take over when the claim is older than ``lease`` seconds (its writer was lost). A result is named by a file that
appears once it is whole, and expires after ``seconds``.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vitalgrain.functions.errors import ValidationError
from vitalgrain.operators.sinks import _hadoop, create_once, read_bytes


def fingerprint(df: DataFrame) -> str:
    """A digest of what a result depends on: the plan, and size and time of each input file."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    if "LogicalRDD" in plan or "ExternalRDD" in plan or "LocalRelation" in plan:
        raise ValidationError("results of rows that are in no file can't be told apart")
    files = []
    for name in sorted(df.inputFiles()):
        p, fs = _hadoop(spark, name)
        status = fs.getFileStatus(p)
        files.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([plan, files]).encode()).hexdigest()


class SharedCache:
    def __init__(self, spark: SparkSession, folder: str, seconds: float = 1800.0, lease: float = 600.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.folder, self.seconds, self.lease, self.clock, self.sleep = spark, folder.rstrip("/"), seconds, lease, clock, sleep

    def _files(self, folder: str, prefix: str) -> list[dict]:
        p, fs = _hadoop(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((json.loads(read_bytes(self.spark, f"{folder}/{n}")) | {"name": n} for n in names if n.startswith(prefix)), key=lambda x: x["at"])

    def _found(self, folder: str) -> DataFrame | None:
        fresh = [x for x in self._files(folder, "result-") if self.clock() - x["at"] < self.seconds]
        return self.spark.read.schema(StructType.fromJson(fresh[-1]["schema"])).parquet(f"{folder}/{fresh[-1]['data']}") if fresh else None

    def get(self, operation: str, params: dict, role: str, df: DataFrame) -> DataFrame:
        """The stored result of ``df``, made now if there is none that is fresh."""
        key = hashlib.sha256(json.dumps([operation, params, role, fingerprint(df)], sort_keys=True, default=str).encode()).hexdigest()
        folder = f"{self.folder}/{operation}-{key}"
        while True:
            claims = self._files(folder, "claim-")  # looked at before the results: a claim made since has the number that is tried below
            taken = {x["claim"] for x in self._files(folder, "result-")}
            if (found := self._found(folder)) is not None:
                return found
            if any(x["name"] not in taken and self.clock() - x["at"] < self.lease for x in claims):
                self.sleep(0.2)
                continue
            number = len(claims)
            claim = f"claim-{number:06d}"
            if not create_once(self.spark, f"{folder}/{claim}", json.dumps({"at": self.clock()}).encode()):
                continue
            data = f"data-{uuid.uuid4().hex}"
            df.write.parquet(f"{folder}/{data}")
            create_once(self.spark, f"{folder}/result-{number:06d}", json.dumps({"at": self.clock(), "data": data, "claim": claim, "schema": json.loads(df.schema.json())}).encode())

    def invalidate(self, prefix: str = "") -> int:
        """Delete the results of operations that begin so; how many."""
        p, fs = _hadoop(self.spark, self.folder)
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)] if fs.exists(p) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def expire(self) -> int:
        """Delete data of results that aren't fresh; how many."""
        p, fs = _hadoop(self.spark, self.folder)
        gone = 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            folder = f"{self.folder}/{s.getPath().getName()}"
            for x in self._files(folder, "result-"):
                if self.clock() - x["at"] >= self.seconds:
                    data, _ = _hadoop(self.spark, f"{folder}/{x['data']}")
                    gone += bool(fs.delete(data, True))
        return gone
