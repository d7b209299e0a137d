"""Helpers shared by the training-data operators: shared folders, files and hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder and everything runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local master may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{LOCAL_CHECKPOINTS}/{os.getpid()}"
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of its own below the shared one."""
    made = f"{shared_dir(spark)}/vitalgrain/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(made)
    return made


def made_folders() -> list[str]:
    """The work folders made so far."""
    return list(_MADE)


def remove_unread(spark: SparkSession, folders: list[str], df: DataFrame) -> list[str]:
    """Delete the folders of which ``df`` reads nothing; the others."""
    read = df.inputFiles() if folders else []
    kept = [x for x in folders if any(x.split(":", 1)[-1].lstrip("/") in f for f in read)]
    for path in folders:
        if path not in kept:
            remove(spark, path)
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has a column of that name (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """(rows with a row number, its column), written once so that it holds; an id may be null or stand in several rows."""
    row = free_name(df, "_row")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), f"{work_dir(df.sparkSession, 'rows')}/numbered"), row


def open_fs(path: str):
    """(pyarrow file system, path in it) for any shared folder; works on executors."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int = 2):
    """True where crc32(doc_id as text) leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: long texts make large rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidied(f):
    """The Arrow function ``f``, giving memory back at the end of a task: idle workers stay for a while."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def tidied_result(result):
    """``result``, after giving back what a group of some size has held."""
    tidy()
    return result


def tidy() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_columns(df: DataFrame, make, schema: str, reads: list[str], drops: tuple[str, ...] = ()) -> DataFrame:
    """Append columns made batch by batch in Arrow.

    ``make()`` runs once per task and gives a function from the columns ``reads`` (Python lists) to a
    list of value lists, one per field of ``schema``. A field that has the name of a column of ``df``
    takes its place; ``drops`` leave.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    new = StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name not in drops and f.name not in new.names]
    rest = [f.name for f in kept]
    types = [f.type for f in to_arrow_schema(new)]

    def run(batches):
        score = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = score(*(batch.column(c).to_pylist() for c in reads))
            made = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + made, rest + new.names)

    needed = [c for c in df.columns if c in rest or c in reads]
    return df.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(tidied(run), StructType(kept + new.fields))


def hash_sample(df: DataFrame, keys: str | list[str], rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the columns ``keys``; all of a smaller table.

    Rows that repeat all columns count once, so that copies of one row can't enlarge the sample.
    """
    every = max(1, -(-df.count() // rows))
    own = [keys] if isinstance(keys, str) else keys
    return df if every == 1 else df.where(F.pmod(F.xxhash64(*own), F.lit(every)) == 0).dropDuplicates()


def plain_scan(docs: DataFrame) -> bool:
    """Whether the plan is one file scan with filters and projections, so that its splits can be read again.

    A file that is read twice gives two splits of one name, so such a scan isn't plain.
    """
    import re

    plan = docs._jdf.queryExecution().optimizedPlan()
    names = [re.sub(r"^[\s:+-]*", "", line).split(" ")[0] for line in plan.toString().strip().split("\n")]
    if not docs.inputFiles() or not all(n in ("Project", "Filter") or n.startswith("Relation") for n in names):
        return False
    files = list(plan.collectLeaves().head().relation().location().inputFiles())
    return len(files) == len(set(files))


def rereadable(docs: DataFrame, at: str) -> DataFrame:
    """The documents by a plan whose splits hold the same rows in the same order each time."""
    return docs if plain_scan(docs) else materialize(docs, f"{at}/documents")


def split_column():
    """Names the file split of a row."""
    return F.concat_ws(":", F.input_file_name(), F.input_file_block_start())


def chunked(batches, columns: list[str], text: int, most_words: int):
    """(name, rows) of each chunk: rows of one split, in order, up to about ``most_words`` words.

    The first column names the split, column ``text`` has the texts. Where chunks begin depends on the
    rows alone, so that a second reading meets the same chunks.
    """
    held, name, part, n = [], None, 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != name or n >= most_words:
                if held:
                    yield f"{name}:{part:06d}", held
                part = part + 1 if row[0] == name else 0
                held, name, n = [], row[0], 0
            held.append(row)
            n += (len(row[text]) if row[text] else 0) // 6
    if held:
        yield f"{name}:{part:06d}", held


def chunk_file(name: str) -> str:
    import hashlib

    return hashlib.sha1(name.encode()).hexdigest()


def save_file(folder: str, name: str, data: bytes) -> None:
    """Write under another name and rename, so that a file is whole or not there.

    A file that is there came from another try of the same task and holds the same bytes.
    """
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    if fs.get_file_info(f"{base}/{name}").type.name != "NotFound":
        return
    temp = f"{base}/{name}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(data)
    fs.move(temp, f"{base}/{name}")


def load_file(folder: str, name: str) -> bytes:
    fs, base = open_fs(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()
