"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern. Each distinct word of the corpus is merged once, by a fold
of Spark's higher-order functions over its bytes that always takes the lowest-ranked adjacent pair,
leftmost first. Ranks come from a literal map: the pairs (left id, right id) -> merged id form a
sparse matrix whose rows are laid over each other without collisions (row displacement), so that a
lookup costs two array reads.

Words and ids travel packed, never as one row per token:

1. Each chunk of documents (a part of one file split) sends its distinct words, sorted and packed, to
   groups by a hash of the word.
2. A group unites the words of all chunks, folds each, and answers every chunk with the ids of its
   words, in their order. The answers of a chunk become one file in the shared folder.
3. The chunk reads its documents again, makes the same order, and so has each word's ids.

A frequent word is one entry per chunk, so no group grows with its count. Decoding concatenates the
byte pieces of the ids.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to nothing;
repeated rows give repeated rows; an empty table gives no rows; other columns are kept, but one named
like an output column gives way. A word of n bytes takes up to n - 1 merges over arrays of n entries,
so only very long unbroken words are slow, each once.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.llm.common import chunk_file, chunked, load_file, materialize, rereadable, save_file, small_batches, split_column, tidied, tidied_result, tidy, work_dir

SHIFT = 17  # ids are below 2**17
MASK = 2**SHIFT - 1
NONE = 2 ** (2 * SHIFT)  # states from here on don't merge
LAST = 2**60  # the state of a last token, above its id
EMPTY = -1  # a cell without a pair while the table is made


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=1)
def merge_table(path: str) -> tuple[list[int], list[int]]:
    """(offset of each left id's row, cells): cell offset[left] + right holds left << SHIFT | merged, or None."""
    ranks = load_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    size = max(ranks.values()) + 1
    room = 1 << int(np.ceil(np.log2(size + 4 * sum(map(len, rows.values())))))
    cells = np.full(room, EMPTY, np.int64)
    offsets = np.zeros(size, np.int64)
    rng = np.random.default_rng(0)
    for left, entries in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array([r for r, _ in entries], np.int64)
        at = 0
        while (cells[at + rights] != EMPTY).any():
            at = int(rng.integers(room - size))
        cells[at + rights] = (left << SHIFT) | np.array([m for _, m in entries], np.int64)
        offsets[left] = at
    return offsets.tolist(), [None if c == EMPTY else c for c in cells.tolist()]


def let(value: Column, body) -> Column:
    """body(value), with value computed once and shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Tokenizer:
    """The fold for one vocabulary; ``path`` is a rank file.

    The rank map is a literal row, written to ``at`` and taken as a scalar: it reaches the tasks as a
    constant, without standing in every description of the plan, which would be megabytes each.
    """

    def __init__(self, spark: SparkSession, path: str, at: str):
        self.ranks = load_ranks(path)
        offsets, cells = merge_table(path)
        row = (offsets, cells, [self.ranks[bytes([b])] for b in range(256)])
        tables = materialize(spark.createDataFrame([row], "offsets array<int>, cells array<bigint>, bytes array<bigint>"), f"{at}/ranks")
        self.tables = tables.select(F.struct("offsets", "cells", "bytes").alias("t")).scalar()

    def fold(self, t: Column, word: Column) -> Column:
        """The ids of one word, given the tables: merge the lowest-ranked pair until none is left.

        The state has a long per token: the id that merging it with its right neighbour gives, shifted
        above its own id; values from NONE on say that the two don't merge.
        """

        def pair(left: Column, right: Column) -> Column:
            cell = F.get(t["cells"], F.get(t["offsets"], left.cast("int")) + right.cast("int"))
            return F.shiftleft(cell.bitwiseXOR(F.shiftleft(left, SHIFT)), SHIFT).bitwiseOR(left)

        def own(x: Column) -> Column:
            return x.bitwiseAND(MASK)

        def merge(acc: Column, least: Column) -> Column:
            best = F.shiftright(least, SHIFT)

            def at_place(at: Column) -> Column:  # from 1: tokens at and at + 1 become best
                before = F.concat(F.slice(acc, F.lit(1), at - 2), F.array(F.coalesce(pair(own(F.get(acc, at - 2)), best), own(F.get(acc, at - 2)) + LAST)))
                now = F.array(F.coalesce(pair(best, own(F.get(acc, at + 1))), best + LAST))
                behind = F.slice(acc, at + 2, F.size(acc))
                return F.when(at > 1, F.concat(before, now, behind)).otherwise(F.concat(now, behind))

            return let(F.array_position(acc, least).cast("int"), at_place)

        def all_merges(ids: Column) -> Column:
            start = F.transform(ids, lambda x, i: F.coalesce(pair(x, F.get(ids, i + 1)), x + LAST))
            return F.aggregate(
                F.sequence(F.lit(2), F.size(ids)),
                start,
                lambda acc, _: let(F.array_min(acc), lambda least: F.when(least >= NONE, acc).otherwise(merge(acc, least))),
                lambda acc: F.transform(acc, lambda x: own(x).cast("int")),
            )

        chars = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        ids = F.transform(chars, lambda c: F.get(t["bytes"], F.ascii(c)))
        return let(ids, lambda x: F.when(F.size(x) > 1, all_merges(x)).otherwise(F.transform(x, lambda y: y.cast("int"))))

    def folded(self, df: DataFrame, words: str, out: str = "ids") -> DataFrame:
        """Adds ``out``: the ids of each word of the array ``words``."""
        made = let(F.col("_ranks"), lambda t: F.transform(words, lambda w: self.fold(t, w)))
        return df.withColumn("_ranks", self.tables).withColumn(out, made).drop("_ranks")


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zlib.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(data, np.uint32, n, 4)) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)]


def group_of(words: list[bytes], groups: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % groups


@lru_cache(maxsize=4)
def plain_pattern(pattern: str) -> str | None:
    """The pattern for Python's own engine, with letters, numbers and spaces written out; None if more than these is in it.

    The ranges come from the engine that knows the classes, so both split alike, only faster. They end
    with the basic plane, as the engine has tables for that alone; texts beyond it take the other engine.
    """
    import re

    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    inner = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = (m[0] for m in regex.finditer(f"{name}+", every))
        inner[name] = "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in runs)
    known = [(r"[^\s\p{L}\p{N}]", "[^" + "".join(inner.values()) + "]"), (r"\S", f"[^{inner[chr(92) + 's']}]"), *((k, f"[{v}]") for k, v in inner.items())]
    marks = [f"\0{i}\0" for i in range(len(known))]
    for (old, _), mark in zip(known, marks, strict=True):
        pattern = pattern.replace(old, mark)
    if re.search(r"[\\\[]", pattern):
        return None
    for (_, new), mark in zip(known, marks, strict=True):
        pattern = pattern.replace(mark, new)
    return pattern


class Places(dict):
    """Word -> place of its first occurrence among the words."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Chunk:
    """The distinct words of a chunk, by group and first occurrence; on request the words of each text by their place."""

    def __init__(self, texts: list, split, groups: int, tokens: bool = False):
        places = Places()
        self.tokens = None
        if tokens:
            parts = [np.fromiter(map(places.__getitem__, split(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
            self.sizes = np.array([len(p) for p in parts], np.int64)
            self.tokens = np.concatenate(parts)
        else:
            found: dict[str, None] = {}
            for t in texts:
                if t:
                    found.update(dict.fromkeys(split(t)))
            places = found
        coded = [w.encode("utf-8", "surrogatepass") for w in places]
        g = group_of(coded, groups)
        order = np.argsort(g, kind="stable")
        self.words, self.groups = [coded[i] for i in order.tolist()], g[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def parts(self):
        """(group, its words)."""
        cuts = np.flatnonzero(np.diff(self.groups)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.words)], strict=True):
            if b > a:
                yield int(self.groups[a]), self.words[a:b]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count], one behind the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None, group_words: int = 500_000, chunk_words: int = 1_200_000) -> DataFrame:
    """Adds ``out``, the ids of ``text``, with ``out``_sha256, the digest of the ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded again in the same pass, as ``decode`` would, into a column of that name.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    small_batches(spark, 500)
    tidy()  # the driver holds the tables and whatever earlier training left
    at = work_dir(spark, "bpe")
    docs = rereadable(docs, at)
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    groups = max(1, size // 6 // group_words)
    tokenizer = Tokenizer(spark, path, at)

    plain = plain_pattern(pattern)

    def splitter():
        import re

        import regex

        slow = regex.compile(pattern).findall
        if not plain:
            return slow
        fast, beyond = re.compile(plain).findall, re.compile("[\U00010000-\U0010ffff]").search
        return lambda t: fast(t) if t.isascii() or not beyond(t) else slow(t)

    def send(batches):
        split = splitter()
        for name, rows in chunked(batches, ["split", "x"], 1, chunk_words):
            parts = [(g, name, pack_words(w)) for g, w in Chunk([r[1] for r in rows], split, groups).parts()]
            for i in range(0, len(parts), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[i : i + 64], strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["g", "chunk", "words"])

    sent = materialize(docs.select(split_column().alias("split"), F.col(text).alias("x")).mapInArrow(tidied(send), "g int, chunk string, words binary"), f"{at}/sent")

    def unite(rows):
        words = sorted(set().union(*map(unpack_words, rows["words"].to_pylist())))
        return tidied_result(pa.table({"g": pa.array([rows["g"][0].as_py()], pa.int32()), "w": pa.array([[w.decode("utf-8", "surrogatepass") for w in words]], pa.list_(pa.string()))}))

    united = sent.groupBy("g").applyInArrow(unite, "g int, w array<string>")
    folded = tokenizer.folded(united, "w")

    def answer(asked, known):
        """Per chunk: how many ids each of its words has, and the ids, packed."""
        ids = known["ids"].combine_chunks().values
        values, offsets = ids.values.to_numpy().astype(np.uint32), ids.offsets.to_numpy()
        place = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(known["w"][0].as_py())}
        packed = []
        for data in asked["words"].to_pylist():
            i = np.fromiter(map(place.__getitem__, unpack_words(data)), np.int64)
            n = (offsets[i + 1] - offsets[i]).astype(np.int64)
            packed.append(zlib.compress(np.uint32(len(n)).tobytes() + n.astype(np.uint32).tobytes() + gather(values, offsets[i], n).tobytes(), 1))
        del place, ids, values
        return tidied_result(pa.table({"chunk": asked["chunk"], "g": asked["g"], "ids": pa.array(packed, pa.binary())}))

    answers = sent.groupBy("g").cogroup(folded.groupBy("g")).applyInArrow(answer, "chunk string, g int, ids binary")

    def save(key, rows):
        """One file per chunk: the number of ids of each word, then the ids, in order of groups."""
        counts, ids = [], []
        for i in np.argsort(rows["g"].to_numpy()).tolist():
            data = np.frombuffer(zlib.decompress(rows["ids"][i].as_py()), np.uint32)
            counts.append(data[1 : 1 + data[0]])
            ids.append(data[1 + data[0] :])
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        save_file(f"{at}/answers", chunk_file(key[0].as_py()), zlib.compress(np.uint32(len(counts)).tobytes() + counts.tobytes() + ids.tobytes(), 1))
        return pa.table({"chunk": pa.array([key[0].as_py()])})

    answers.groupBy("chunk").applyInArrow(save, "chunk string").write.parquet(f"{at}/saved")

    new = StructType.fromDDL(f"{out} array<int>, {out}_sha256 string" + (f", {decoded} binary" if decoded else ""))
    back = Decoder(tokenizer.ranks) if decoded else None
    rest = [f for f in docs.schema.fields if f.name not in new.names]
    result = StructType([*rest, *new.fields])
    names = ["_split", *(f.name for f in rest)]
    columns = [split_column().alias("_split"), *(F.col(f"`{f.name}`") for f in rest)]
    if text in new.names:  # the text gives way to an output column
        names.append("_x")
        columns.append(F.col(text).alias("_x"))
    x = names.index(text if text not in new.names else "_x")

    def apply(batches):
        from itertools import chain

        split = splitter()
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field(f.name).type for f in rest]
        for name, rows in chunked(chain([first], batches), names, x, chunk_words):
            c = Chunk([r[x] for r in rows], split, groups, tokens=True)
            counts, values = np.zeros(0, np.int64), np.zeros(0, np.uint32)
            if c.words:
                data = np.frombuffer(zlib.decompress(load_file(f"{at}/answers", chunk_file(name))), np.uint32)
                if data[0] != len(c.words):
                    raise RuntimeError(f"{name} was read otherwise than before")
                counts, values = data[1 : 1 + data[0]].astype(np.int64), data[1 + data[0] :]
            starts = np.cumsum(counts) - counts
            bounds = np.concatenate([[0], np.cumsum(c.sizes)])
            for i in range(0, len(rows), 250):
                part = rows[i : i + 250]
                place = c.rank[c.tokens[bounds[i] : bounds[i + len(part)]]]
                n = counts[place]
                ids = gather(values, starts[place], n)
                ends = np.concatenate([[0], np.cumsum(n)])[bounds[i : i + len(part) + 1] - bounds[i]]
                made = [
                    *(pa.array([r[1 + k] for r in part], t) for k, t in enumerate(types)),
                    lists := pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                ]
                if back:
                    made.append(back(lists))
                yield pa.RecordBatch.from_arrays(made, result.names)

    return docs.select(*columns).mapInArrow(tidied(apply), result)


class Decoder:
    """Lists of ids -> the bytes that they stand for, piece by piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.table = None  # made where it is used

    def __call__(self, lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.table is None:
            self.table = pa.array(self.pieces, pa.binary())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        taken = self.table.take(lists.flatten())
        edges = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(edges[ends])), data])


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for, piece by piece. A null list decodes to nothing."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    back = Decoder(load_ranks(path))
    rest = [f for f in df.schema.fields if f.name != out]
    result = StructType([*rest, StructField(out, BinaryType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), back(batch.column(ids))], result.names)

    small_batches(df.sparkSession, 500)
    return df.mapInArrow(tidied(run), result)
