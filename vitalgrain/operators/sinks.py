"""Sinks: staged overwrites and upserts of Parquet tables, exports and append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.operators.joins import upsert
from vitalgrain.operators.quality import unknown_only


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file that must not be there yet, whole and in one step; False if somebody else has.

    It is written under another name first. Hadoop's rename refuses a name that is taken; on local disks, where it would replace, a link does.
    """
    from py4j.protocol import Py4JJavaError

    target, fs = _hadoop(spark, path)
    temp, _ = _hadoop(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(temp, target)
        files, of = spark.sparkContext._jvm.java.nio.file.Files, spark.sparkContext._jvm.java.nio.file.Path.of
        files.createLink(of(fs.makeQualified(target).toUri()), of(fs.makeQualified(temp).toUri()))
        return True
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        return False
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in a table's place; the old one goes last, and comes back if the new one can't take its place."""
    new, fs = _hadoop(spark, staged)
    target, _ = _hadoop(spark, path)
    old, _ = _hadoop(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
    if not fs.exists(new):
        raise FileNotFoundError(f"{staged} isn't there")
    had = fs.exists(target)
    if had and not fs.rename(target, old):  # a rename reports failure by its result
        raise OSError(f"{path} can't be moved aside; it is unchanged, the new rows are in {staged}")
    done = False
    try:
        done = fs.rename(new, target)
    finally:
        if not done and had and not fs.rename(old, target):
            raise OSError(f"{path} can't be put back; its rows are in {old}, the new ones in {staged}")
    if not done:
        raise OSError(f"{staged} can't be moved to {path}, which is unchanged")
    if had:
        fs.delete(old, True)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside and swap, so that a plan may read the table that it replaces."""
    staged = f"{path}.new-{uuid.uuid4().hex[:8]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(staged)
    swap(df.sparkSession, staged, path)


def upsert_table(new: DataFrame, path: str, key: str) -> None:
    spark = new.sparkSession
    overwrite(upsert(spark.read.parquet(path), new, key) if exists(spark, path) else new, path)


def upsert_new_content(new: DataFrame, path: str, key: str, fields: list[str]) -> None:
    """Rows of known content are left out, the others are stamped with their hash and upserted."""
    spark = new.sparkSession
    known = spark.read.parquet(path) if exists(spark, path) else None
    from vitalgrain.operators.quality import hashed

    upsert_table(unknown_only(new, known, fields) if known is not None else hashed(new, fields), path, key)


def bucketed(df: DataFrame, table: str, key: str, buckets: int, unique: bool = False) -> None:
    """A table bucketed and sorted by its join key; a unique key is checked first."""
    if unique and df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a table another name in its database; a table of that name goes."""
    quoted = lambda name: ".".join(f"`{part}`" for part in name.split("."))
    spark.sql(f"DROP TABLE IF EXISTS {quoted(target)}")
    spark.sql(f"ALTER TABLE {quoted(source)} RENAME TO {quoted(target)}")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def log_lines(df: DataFrame, message: str, level: str = "INFO") -> DataFrame:
    """One JSON log line per row: level, message, and the row's fields, nested ones flattened as parent_child; nulls are left out."""
    from pyspark.sql.types import StructType

    def flat(kind, column, name):
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in flat(f.dataType, column[f.name] if column is not None else F.col(f"`{f.name}`"), f"{name}_{f.name}" if name else f.name)]
        return [column.alias(name)]

    return df.select(F.to_json(F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"), *flat(df.schema, None, ""))).alias("line"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; times in ISO form."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}).alias("json"))


def from_json_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def to_csv_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns)).alias("csv"))


def to_markdown_rows(df: DataFrame) -> DataFrame:
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    return df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("markdown"))
