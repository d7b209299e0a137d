"""Text search by an inverted index of trigrams: postings per shard, intersected, and then verified by the pattern itself.

The index holds, for each trigram of a text in lower case, the ids of its rows: a row per trigram and block of 65,536 ids, the ids
as distances from the block's start, in folders by a hash of the trigram. A search reads the folders of its pattern's trigrams only, keeps the ids
that have them all, and tests these rows alone. Tasks send postings of stretches of a few million characters, a row per trigram and block, and not a row
per trigram and text; longer texts are cut with an overlap. Common trigrams spread over blocks; a pattern without three letters in a row is a scan. Rows of a null id
are in no posting and are always tested.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrain.functions import filters as L

BLOCK = 1 << 16
SIZE = 3
#: Long s, dotless i, and the dot that lower case leaves of a dotted capital.
FOLD = ("\u017f", "\u0131", "\u0307")


def _shard(gram: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shards)).cast("int")


def folded(text: Column) -> Column:
    """Lower case, with the few letters that match s and i in either case."""
    return F.translate(F.lower(text), "".join(FOLD), "si")


def _stretch(ids: list[int], texts: list[str]):
    """Batches (gram, block, ids) of a few texts, each id once per trigram."""
    import pyarrow as pa

    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if len(codes) < SIZE:
        return
    used = np.zeros(0x110000, bool)
    used[codes] = True
    alphabet = np.flatnonzero(used)
    own, place = np.unique(np.array(ids, np.int64), return_inverse=True)
    low = len(own).bit_length()
    if (len(alphabet) ** SIZE).bit_length() + low > 64:  # one text always fits
        half = len(texts) // 2
        yield from _stretch(ids[:half], texts[:half])
        yield from _stretch(ids[half:], texts[half:])
        return
    c = (np.cumsum(used, dtype=np.uint32) - np.uint32(1))[codes].astype(np.uint64)
    base = np.uint64(len(alphabet))
    keys = (c[:-2] * base + c[1:-1]) * base + c[2:]
    sizes = np.array([len(t) for t in texts], np.int64)
    keys = keys << np.uint64(low) | np.repeat(place.astype(np.uint64), sizes)[: len(keys)]
    whole = np.ones(len(codes), bool)
    for k in range(1, SIZE):
        whole[(np.cumsum(sizes) - k)[sizes >= k]] = False  # what starts here goes on in the next text
    keys = keys[whole[: len(keys)]]
    if not len(keys):
        return
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    gram, found = keys >> np.uint64(low), own[(keys & np.uint64(2**low - 1)).astype(np.int64)]
    block = found // BLOCK
    new = np.ones(len(keys), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    g = gram[at]
    letters = alphabet[np.stack([g // (base * base), g // base % base, g % base], 1).astype(np.int64)]
    names = letters.astype("<u4").tobytes().decode("utf-32-le")
    steps = pa.array(np.append(at, len(keys)).astype(np.int32))
    lists = pa.ListArray.from_arrays(steps, pa.array((found - block * BLOCK).astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array([names[i : i + SIZE] for i in range(0, len(names), SIZE)]), pa.array(block[at]), lists], ["gram", "block", "ids"])


def postings(batches, most: int = 1 << 22):
    """(gram, block, ids) of batches (id, text as UTF-8), by stretches of about ``most`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, data in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            text = data.as_py().decode("utf-8", "replace")
            for a in range(0, len(text) - SIZE + 1, most):
                ids.append(i)
                texts.append(text[a : a + most + SIZE - 1])
                size += len(texts[-1])
                if size >= most:
                    yield from _stretch(ids, texts)
                    ids, texts, size = [], [], 0
    if ids:
        yield from _stretch(ids, texts)


def build(df: DataFrame, key: str, text: str, path: str, shards: int = 64) -> None:
    """Write the index of a column of texts by whole-number ids."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), folded(F.col(text)).cast("binary").alias("text"))
    parts = rows.mapInArrow(postings, "gram string, block long, ids array<int>")
    blocks = parts.groupBy("gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    blocks.withColumn("shard", _shard(F.col("gram"), shards)).repartition("shard").sortWithinPartitions("shard", "gram", "block").write.partitionBy("shard").parquet(path)


def literals(pattern: str) -> list[str]:
    """Texts that each match of a pattern holds: its runs of plain characters outside of groups, sets, choices and what may be left out."""
    if "|" in pattern or "(?" in pattern:
        return []
    held = re.sub(r"\\([^A-Za-z0-9])", lambda m: chr(0xE000 + ord(m[1]) % 0x1000), pattern)  # escaped characters stand for themselves
    plain = re.sub(r"\\[A-Za-z0-9]|\[[^\]]*\]|\([^)]*\)", "\x00", held)
    plain = re.sub(r".(?:[*?]|\{[^}]*\})", "\x00", plain)
    back = str.maketrans({chr(0xE000 + c): chr(c) for c in range(128)})
    return [x.translate(back) for x in re.split(r"[\x00.^$+]+", plain) if x]


def grams_of(texts: list[str]) -> list[str]:
    """The trigrams that prune: those of letters whose cases are one to one (Greek has a final sigma, the micro sign a twin)."""
    fold = str.maketrans({FOLD[0]: "s", FOLD[1]: "i", FOLD[2]: ""})
    low = [t.lower().translate(fold) for t in texts]
    every = {t[i : i + SIZE] for t in low for i in range(len(t) - SIZE + 1)}
    return sorted(g for g in every if all(ord(c) < 0x180 and c != "µ" for c in g))


def candidates(df: DataFrame, key: str, path: str, grams: list[str], shards: int) -> DataFrame:
    """(id) of the rows whose texts hold all the trigrams."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _shard(F.col("gram"), shards).alias("s"))
    folders = sorted({r.s for r in wanted.collect()})  # as many as the pattern has trigrams at most
    kind = "gram string, block long, ids array<int>, shard int"
    found = spark.read.schema(kind).parquet(path).where(F.col("shard").isin(folders) & F.col("gram").isin(grams))
    return found.select(F.explode(F.transform("ids", lambda i: i + F.col("block") * BLOCK)).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search(df: DataFrame, key: str, text: str, path: str, term: str, literal: bool = True, shards: int = 64) -> DataFrame:
    """The rows whose text holds a term (or matches a pattern, in either case) as the plain filter has it, by way of the index."""
    test = L.contains_literal([text], term) if literal else L.contains(text, term)
    grams = grams_of([term] if literal else literals(term))
    if not grams:
        return df.where(test)
    some = candidates(df, key, path, grams, shards)
    own = df.where(F.col(key).isNotNull())
    hits = own.join(some.select(F.col("id").cast(df.schema[key].dataType).alias(key)), key, "left_semi").where(test)
    return hits.select(*df.columns).unionByName(df.where(F.col(key).isNull() & test))
