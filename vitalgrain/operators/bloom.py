"""Bloom filters as small tables of bitmaps, built by aggregates and tested by expressions.

A value's hash chooses a block of 32,768 bits and ``PROBES`` bits in it, so a test looks at one row. Blocks of filters of
the same size merge by OR; a filter grows with what it was built for and is broadcast only up to ``MOST_BROADCAST`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one of Spark's bitmaps, and what a block holds at about one false hit in 250.
BLOCK_BITS, PER_BLOCK = 32_768, 2_700
PROBES = 6
MOST_BROADCAST = 2_048  # blocks of 4 KB


def blocks_for(rows: int) -> int:
    """Blocks of a filter for so many different values."""
    return max(1, -(-rows // PER_BLOCK))


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), F.lit(blocks))


def _bits(value: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PROBES)]


def build(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, bits) of the values that aren't null; sums before the shuffle, one row per block after it."""
    rows = df.where(F.col(column).isNotNull()).select(_block(F.col(column), blocks).alias("block"), F.explode(F.array(*_bits(F.col(column)))).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """One filter of several of one size."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def mark(df: DataFrame, column: str, found: DataFrame, blocks: int, out: str) -> DataFrame:
    """Adds ``out``: whether the filter may hold the value; never false for one that it was built with."""

    powers = F.array(*(F.lit(1 << i) for i in range(8)))

    def bit(k: Column) -> Column:
        byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(k / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(powers, (k % 8 + 1).cast("int"))) != 0

    rows = found.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    rows = F.broadcast(rows) if blocks <= MOST_BROADCAST else rows
    hit = F.lit(True)
    for k in _bits(F.col(column)):
        hit = hit & bit(k)
    return df.withColumn("_own", _block(F.col(column), blocks)).join(rows, F.col("_own") == F.col("_block"), "left").withColumn(out, F.coalesce(F.col("_bits").isNotNull() & hit, F.lit(False))).drop("_own", "_block", "_bits")


def anti_join(new: DataFrame, known: DataFrame, column: str, stored: DataFrame | None = None, blocks: int | None = None, reverse_for: int | None = None) -> DataFrame:
    """The rows of ``new`` whose ``column`` isn't in ``known``; null counts as unknown.

    Rows that the stored filter of ``known`` rules out don't reach the join. ``reverse_for``, about how many rows ``new`` has,
    builds a filter of the others' values, so that of ``known`` only what may match is shuffled.
    """
    some = known.select(F.col(column)).where(F.col(column).isNotNull())
    if stored is None:
        maybe, surely = new, None
    else:
        marked = mark(new, column, stored, blocks, "_maybe")
        maybe, surely = marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")
    if reverse_for is not None:
        size = blocks_for(reverse_for)
        some = mark(some, column, build(maybe, column, size), size, "_near").where("_near").drop("_near")
    left = maybe.join(some.distinct(), column, "left_anti").select(*new.columns)
    return left if surely is None else left.unionByName(surely)
