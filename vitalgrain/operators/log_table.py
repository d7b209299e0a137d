"""A keyed table as a log of changes: an upsert writes its own rows only, readers merge, compaction folds.

Layout below the table's folder: ``data/commit=<id>/bucket=<n>/`` holds the rows of one change by hash of the key;
``log/<version>.json`` lists the folders that a version adds and takes away. A log file is written under another name and
renamed to a name that must not be there yet, so versions are in one order and writers at the same time lose nothing:
who comes second takes the next number. A reader fixes its folders when it plans and sees one version, whatever is
committed meanwhile.

Merging keeps, per key and field, the value of the latest change that has one (null never overwrites); of several rows of
a key in one change the last by all columns counts, and rows of a null key never meet. Compaction writes the merged
rows of some buckets as one folder that stands for the changes up to the version that it has read, so a change that is
committed meanwhile still goes over it. Folders that no version in use lists are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vitalgrain.functions.errors import NotFoundError, ValidationError
from vitalgrain.operators import bloom
from vitalgrain.operators.quality import hashed
from vitalgrain.operators.sinks import create_once, read_bytes

WIDTH = 12  # digits of a version
EVERY = 20  # versions between entries that list all folders


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass
class Version:
    """What a version consists of: (commit, bucket) -> sequence of the change."""

    number: int = 0
    key: str = ""
    buckets: int = 0
    schema: StructType = field(default_factory=StructType)
    folders: dict[tuple[str, int], int] = field(default_factory=dict)
    filters: list[str] | None = field(default_factory=list)  # of contents; None once a change came without one
    blocks: int = 0


class LogTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- versions ----
    def _numbers(self) -> list[int]:
        folder, fs = _fs(self.spark, f"{self.path}/log")
        return sorted(int(s.getPath().getName()[:WIDTH]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def _entry(self, number: int) -> dict:
        return json.loads(read_bytes(self.spark, f"{self.path}/log/{number:0{WIDTH}d}.json"))

    def version(self, number: int | None = None) -> Version:
        """The state after a version, by default the last one."""
        out = Version()
        numbers = [n for n in self._numbers() if number is None or n <= number]
        begin = max((n for n in numbers if n % EVERY == 0), default=0)
        for n in (n for n in numbers if n >= begin):
            entry = self._entry(n)
            out.number, out.key, out.buckets = n, entry["key"], entry["buckets"]
            if n == begin:
                out.folders = {(c, b): s for c, b, s in entry["state"]}
                out.filters, out.blocks = entry["filters"], entry["blocks"]
            if "filter" in entry:
                out.filters = out.filters if entry["filter"] is None or out.filters is None else [*out.filters, entry["filter"]]
                out.blocks = entry["blocks"] or out.blocks
            else:
                out.filters = None
            have = set(out.schema.names)
            out.schema = StructType([*out.schema.fields, *(f for f in StructType.fromJson(entry["schema"]).fields if f.name not in have)])
            for commit, bucket in entry["removes"]:
                out.folders.pop((commit, bucket), None)
            for commit, bucket, sequence in entry["adds"]:
                out.folders[commit, bucket] = n if sequence is None else sequence
        return out

    def _commit(self, base: Version, entry: dict, check) -> int:
        """Give the entry the next free number; ``check(version)`` says whether it still fits what others have committed."""
        number = base.number
        while True:
            number += 1
            if number % EVERY == 0:  # so that a reader needs the last few entries only
                before = self.version(number - 1)
                entry["state"] = [(c, b, s) for (c, b), s in before.folders.items()]
                entry["filters"], entry["blocks"] = before.filters, entry.get("blocks") or before.blocks
                entry["schema"] = json.loads(StructType([*before.schema.fields, *(f for f in StructType.fromJson(entry["schema"]).fields if f.name not in before.schema.names)]).json())
            if create_once(self.spark, f"{self.path}/log/{number:0{WIDTH}d}.json", json.dumps(entry).encode()):
                return number
            if not check(self.version()):
                raise ValidationError("another writer has changed what this one has read", path=self.path)

    # ---- changes ----
    def _write(self, rows: DataFrame, key: str, buckets: int) -> tuple[str, list[int]]:
        """Write rows by bucket; (commit, buckets that have some)."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
        p, fs = _fs(self.spark, folder)
        return commit, sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket="))

    def upsert_new_content(self, new: DataFrame, key: str, fields: list[str], buckets: int = 16, expected: int = 1_000_000) -> int | None:
        """Commit the rows whose content (by ``fields``) no row of the table has, stamped with their hash; None if there are none.

        Each change leaves a Bloom filter of its contents beside the table, of a size for ``expected`` rows. Rows that no
        filter knows go past the look-up; for the others a filter of theirs keeps the rest of the table out of the shuffle.
        """
        rows, v = hashed(new, fields), self.version()
        blocks = v.blocks or bloom.blocks_for(expected)
        if v.number:
            use = [self.spark.read.parquet(f"{self.path}/filters/{f}") for f in v.filters or []]
            few = use and blocks <= bloom.MOST_BROADCAST
            size = rows.count()
            rows = bloom.anti_join(rows, self.read().select("content_hash"), "content_hash", bloom.merge(*use) if few else None, blocks, size if bloom.blocks_for(size) <= bloom.MOST_BROADCAST else None)
            if not rows.limit(1).count():
                return None
        name = uuid.uuid4().hex
        kept = f"{self.path}/changes/{name}"
        rows.write.parquet(kept)  # read twice, and what it is made from may change
        rows = self.spark.read.schema(rows.schema).parquet(kept)
        bloom.build(rows, "content_hash", blocks).write.parquet(f"{self.path}/filters/{name}")
        done = self.upsert(rows, key, buckets, {"filter": name, "blocks": blocks})
        p, fs = _fs(self.spark, kept)
        fs.delete(p, True)
        return done

    def upsert(self, new: DataFrame, key: str, buckets: int = 16, more: dict | None = None) -> int:
        """Commit a change; the number of the new version. The first one makes the table."""
        base = self.version()
        if base.number and base.key != key:
            raise ValidationError(f"the table's key is {base.key}", key=key)
        if "bucket" in new.columns or "commit" in new.columns:
            raise ValidationError("columns can't be called bucket or commit")
        known = {f.name: f for f in base.schema.fields}
        for f in new.schema.fields:
            if f.name in known and known[f.name].dataType != f.dataType:
                raise ValidationError(f"{f.name} is {known[f.name].dataType.simpleString()} in the table", column=f.name)
        schema = StructType([*base.schema.fields, *(f for f in new.schema.fields if f.name not in known)])
        own = [c for c in new.columns if c != key]
        named = new.where(F.col(key).isNotNull())
        by = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in own))
        latest = named.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n") if own else named.distinct()
        commit, some = self._write(latest.unionByName(new.where(F.col(key).isNull())), key, base.buckets or buckets)
        entry = {"id": commit, "key": key, "buckets": base.buckets or buckets, "schema": json.loads(schema.json()), "adds": [(commit, b, None) for b in some], "removes": []} | (more or {})
        return self._commit(base, entry, lambda v: v.key == key and v.buckets == entry["buckets"])

    def _merged(self, version: Version, folders: dict[tuple[str, int], int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], version.schema)
        kind = StructType([*version.schema.fields, StructField("commit", StringType()), StructField("bucket", IntegerType())])
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(kind).parquet(*(f"{self.path}/data/commit={c}/bucket={b}" for c, b in folders))
        order = {c: s for (c, _), s in folders.items()}
        rows = rows.withColumn("_seq", F.element_at(F.create_map(*(x for c, s in order.items() for x in (F.lit(c), F.lit(s)))), F.col("commit"))) if len(set(order.values())) > 1 else rows.withColumn("_seq", F.lit(0))
        names = version.schema.names
        own = [c for c in names if c != version.key]
        known = rows.where(F.col(version.key).isNotNull())
        latest = known.groupBy(version.key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in own)) if own else known.select(version.key).distinct()
        return latest.select(*names).unionByName(rows.where(F.col(version.key).isNull()).select(*names))

    def read(self, number: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version; with ``keys`` only theirs, from their buckets' folders."""
        v = self.version(number)
        if not v.number:
            raise NotFoundError(f"no table at {self.path}")
        folders = v.folders
        if keys is not None:
            kind = v.schema[v.key].dataType
            asked = self.spark.createDataFrame([(k,) for k in keys], StructType([StructField("k", kind)]))
            wanted = {r[0] for r in asked.select(F.pmod(F.xxhash64("k"), F.lit(v.buckets))).collect()}
            folders = {k: s for k, s in folders.items() if k[1] in wanted}
        out = self._merged(v, folders)
        return out if keys is None else out.where(F.col(v.key).isin(keys))

    def compact(self, least: int = 4) -> int | None:
        """Fold the buckets that have at least ``least`` folders; the new version, or None where there is nothing to do."""
        v = self.version()
        per: dict[int, list[tuple[str, int]]] = {}
        for at in v.folders:
            per.setdefault(at[1], []).append(at)
        old = {at: v.folders[at] for b, some in per.items() if len(some) >= least for at in some}
        if not old:
            return None
        commit, some = self._write(self._merged(v, old), v.key, v.buckets)
        stand = max(old.values())
        entry = {"id": commit, "key": v.key, "buckets": v.buckets, "schema": json.loads(v.schema.json()), "adds": [(commit, b, stand) for b in some], "removes": sorted(old), "filter": None, "blocks": v.blocks}
        return self._commit(v, entry, lambda now: all(at in now.folders for at in old))

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the last ``keep`` versions lists; the number of folders deleted."""
        numbers = self._numbers()
        used = {at for n in numbers[-keep:] for at in self.version(n).folders}
        every = {(c, b) for n in numbers for c, b, _ in self._entry(n)["adds"]}
        for commit, bucket in every - used:
            p, fs = _fs(self.spark, f"{self.path}/data/commit={commit}/bucket={bucket}")
            fs.delete(p, True)
        return len(every - used)
