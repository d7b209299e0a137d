"""Substring dedup by prefix-partitioned suffix trees over anchored suffixes.

A word goes if a window of ``window`` words that covers it also starts earlier. Only suffixes that
share at least ``window`` words with another one lie below a deep internal node of the corpus's suffix
tree, so the others are kept out of the trees beforehand, and the rest is compared word by word:

1. Filter. Each chunk of documents (a part of one file split) sends the fingerprints of its windows,
   cut to a few bits more than their number takes, sorted and delta-coded. A group of fingerprints
   answers which of them other chunks have too. An unequal window can pass, an equal one never fails.
2. Suffixes. The chunk reads its documents again. Windows that repeat within it are settled at once,
   word by word. The others that passed are taken by their anchor, the place in the window where a
   hash of ``SEED`` words is least: equal windows have it at the same place. Neighbouring windows of
   one anchor are one row: the words from the anchor on, which is the suffix, and those before it.
3. Trees. Rows are dealt by the first words of their suffix: by one word, and where more than
   ``group_size`` rows share a prefix, by one more word, up to the ``SEED`` words that equal windows
   are sure to share. A task takes the groups one by one in document order, sorts the windows of a group
   by their words, and finds the longest common prefixes of neighbours. Leaves below an internal node
   of depth ``window`` are equal windows; all but the earliest are repeats. A group of any size passes
   in parts, of which only the distinct windows are kept.
4. The chunk reads its documents a third time and takes the answers and what it found out before, a bit
   or two per word: overlapping repeated windows add up to the maximal repeats, which are removed. Nothing
   is hashed or sorted again.

Equal windows of a chunk are one leaf, so a passage that a third of all documents share is a row per
anchor and chunk. Answers carry counts and checksums: a chunk that doesn't meet them stops the job.
A plan that is more than scan, filter and projection is written to the shared folder first.

Defined results: words are white-space runs, unchanged; a null text has none; texts shorter than a
window lose nothing; a null id counts as smaller than any other; among rows of one id the earlier row
in its chunk, then the chunk of the smaller number (a hash of file and place), is earlier; an empty
table gives no rows; other columns stay, and of those a clash with an output column gives way to it.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import chunk_file, chunked, load_file, materialize, rereadable, save_file, small_batches, split_column, tidied, tidied_result, work_dir

LEAST_ID = -(2**63)
SEED = 5  # words of an anchor's hash, and of the longest prefix that splits groups


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for k in range(size):
            out += h[k : k + n] * np.uint64(factor)
            factor = factor * 0x9E3779B97F4A7C15 % 2**64
        return _mix(out)


def in_order(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of numbers of so many bits, and the numbers in that order."""
    low = len(values).bit_length()
    if bits + low > 64:
        by = np.argsort(values, kind="stable")
        return by, values[by]
    joined = values << np.uint64(low) | np.arange(len(values), dtype=np.uint64)  # sorts faster than an order is found
    joined.sort()
    return (joined & np.uint64(2**low - 1)).astype(np.int64), joined >> np.uint64(low)


def number_of(chunk: str) -> int:
    """The chunk's number: 63 bits of a digest of its name."""
    return int.from_bytes(hashlib.sha1(chunk.encode()).digest()[:8], "big") >> 1


class Places(dict):
    """Word -> place among the distinct words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


class Texts:
    """Documents of one part of a split, in order of ids, and their words."""

    def __init__(self, ids: list, texts: list, window: int):
        import xxhash

        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.tokens = [t.split() for t in coded]
        self.order = np.argsort(np.array([LEAST_ID if i is None else i for i in ids], np.int64), kind="stable")
        self.sizes = np.array([len(self.tokens[i]) for i in self.order], np.int64)
        self.ends, self.total, self.window = np.cumsum(self.sizes), int(self.sizes.sum()), window
        self.own = np.array([LEAST_ID if ids[i] is None else ids[i] for i in self.order], np.int64)
        digest = xxhash.xxh64(self.own.tobytes() + np.array([len(t) for t in coded]).tobytes())
        for text in coded:
            digest.update(text)
        self.digest = digest.intdigest()

    def removed(self, gone: np.ndarray) -> list[np.ndarray]:
        """Per document, in the given order of rows: which words go, given the starts of the windows that do."""
        edge = np.zeros(self.total + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        parts = np.split(np.cumsum(edge)[:-1] > 0, self.ends[:-1])
        out: list = [None] * len(parts)
        for place, part in zip(self.order.tolist(), parts, strict=True):
            out[place] = part
        return out

    def note(self, gone: np.ndarray, passed: np.ndarray) -> bytes:
        """Two sets of places among the words, which only the same documents read again."""
        flags = np.zeros((2, self.total), bool)
        flags[0, gone] = True
        flags[1, passed] = True
        return np.array([self.total, self.digest], "<u8").tobytes() + np.packbits(flags).tobytes()

    def noted(self, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        if data[:16] != np.array([self.total, self.digest], "<u8").tobytes():
            return None
        flags = np.unpackbits(np.frombuffer(data, np.uint8, offset=16), count=2 * self.total).reshape(2, -1)
        return np.flatnonzero(flags[0]), np.flatnonzero(flags[1])


class Chunk(Texts):
    """Their windows, and leaves, which are the distinct windows by fingerprint."""

    def __init__(self, ids: list, texts: list, window: int, bits: int):
        import xxhash

        super().__init__(ids, texts, window)
        ordered = [self.tokens[i] for i in self.order]
        places = Places()
        self.words = np.fromiter(map(places.__getitem__, chain.from_iterable(ordered)), np.int32, self.total)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
        del places
        self.hashes = hashes[self.words]
        prints = run_hashes(self.hashes, window) >> np.uint64(64 - bits)
        self.doc = np.repeat(np.arange(len(ordered), dtype=np.int32), self.sizes)
        self.starts = np.flatnonzero(np.arange(len(prints)) + window <= self.ends[self.doc[: len(prints)]])
        prints = prints[self.starts]
        self.by, prints = in_order(prints, bits)  # equal ones in order of document and place
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        self.leaves = prints[first]
        self.leaf = np.cumsum(first) - 1  # of each window, in order ``by``

    def settled(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows that repeat an earlier one of the chunk, first windows whose leaf is ``shared`` with other chunks), as starts.

        Windows of one leaf are compared by their words.
        """
        size = np.bincount(self.leaf, minlength=len(self.leaves))
        at = self.starts[self.by]
        some = np.flatnonzero(size[self.leaf] > 1)
        repeated, first = [], [at[size[self.leaf] == 1][shared[self.leaf[size[self.leaf] == 1]]]]
        while len(some):
            new = np.ones(len(some), bool)
            new[1:] = self.leaf[some[1:]] != self.leaf[some[:-1]]
            head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
            equal = np.ones(len(some), bool)
            for k in range(self.window):
                equal &= self.words[at[some] + k] == self.words[at[head] + k]
            repeated.append(at[some[equal & ~new]])
            first.append(at[some[new]][shared[self.leaf[some[new]]]])
            some = some[~equal]  # others of the same leaf: only equal fingerprints
        return np.concatenate(repeated or [np.zeros(0, np.int64)]), np.sort(np.concatenate(first))

    def anchored(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first window, number of windows, anchor) of each run of neighbouring windows of one anchor."""
        seeds = run_hashes(self.hashes, SEED)
        best, anchor = seeds[first], first.copy()
        for k in range(1, self.window - SEED + 1):
            other = seeds[first + k]
            less = other < best
            best = np.where(less, other, best)
            anchor[less] = first[less] + k
        new = np.ones(len(first), bool)
        new[1:] = (np.diff(first) != 1) | (np.diff(anchor) != 0) | (np.diff(self.doc[first]) != 0)
        at = np.flatnonzero(new)
        return at, np.diff(np.append(at, len(first))), anchor[at]

    def rows(self, first: np.ndarray):
        """Per run: index of its first window, windows, document id, words before the anchor, and words from it on."""
        flat = list(chain.from_iterable(self.tokens[i] for i in self.order))
        at, n, anchor = self.anchored(first)
        for i, k, a, s, own in zip(at.tolist(), n.tolist(), anchor.tolist(), first[at].tolist(), self.own[self.doc[first[at]]].tolist(), strict=True):
            yield i, k, own, b" ".join(flat[s:a]), b" ".join(flat[a : s + k - 1 + self.window])


def pack(leaves: np.ndarray) -> bytes:
    """Sorted numbers as steps, byte by byte."""
    steps = np.diff(leaves, prepend=leaves[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(leaves), width], "<u8").tobytes() + leaves[:1].astype("<u8").tobytes() + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, width, first = (int(x) for x in np.frombuffer(data, "<u8", 3))
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 24).reshape(width, n).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(first)


def several(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Flags the leaves of each part that another part has too."""
    joined = np.concatenate(parts)
    by = np.argsort(joined, kind="stable")
    s = joined[by]
    same = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[by[1:]] |= same
    out[by[:-1]] |= same
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


class Subtree:
    """The windows below one prefix, whose rows come in document order, part by part."""

    def __init__(self, window: int):
        self.window = window
        self.open()

    def open(self) -> None:
        self.places, self.seen = Places(), np.zeros((0, self.window), np.int32)

    def repeats(self, texts: list[bytes], counts: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Flags the windows of the rows that came before; ``part`` numbers the prefixes, of which the first may go on from the call before."""
        words = [t.split(b" ") for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
        begins = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        made = np.concatenate([self.seen, flat[begins[:, None] + np.arange(self.window)]])
        # the leaves in order of their words; equal ones stay in order of documents
        order = np.argsort(np.ascontiguousarray(made.astype(">i4")).view(f"V{4 * self.window}").ravel(), kind="stable")
        leaf = made[order]
        common = np.cumprod(leaf[1:] == leaf[:-1], 1, dtype=np.int8).sum(1)  # longest common prefixes of neighbours
        below = np.zeros(len(order), bool)
        below[1:] = common >= self.window  # not the first leaf of a deep internal node
        flags = np.zeros(len(order), bool)
        flags[order] = below
        of_last = np.concatenate([np.full(len(self.seen), part[0]), np.repeat(part, counts)]) == part[-1]
        self.seen = made[of_last & ~flags]
        return flags[len(flags) - len(begins) :]


def tree_rows(batches, window: int, most: int = 8_000):
    """(chunk, first, flags) of rows (prefix, id, chunk, first, n, left, right) that come by prefix and in document order."""
    import pyarrow as pa

    tree, last = Subtree(window), None
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            rows = batch.slice(a, most)
            prefixes = rows["prefix"].to_pylist()
            if prefixes[0] != last:
                tree.open()
            part = np.concatenate([[0], np.cumsum([x != y for x, y in zip(prefixes[1:], prefixes[:-1], strict=True)])]).astype(np.int64)
            texts = [x + b" " + y if x else y for x, y in zip(rows["left"].to_pylist(), rows["right"].to_pylist(), strict=True)]
            counts = rows["n"].to_numpy().astype(np.int64)
            flags = tree.repeats(texts, counts, part)
            if part[-1]:  # words of prefixes that are done
                kept = sorted(set(tree.seen.ravel().tolist()))
                names = list(tree.places)
                tree.places = Places({names[i]: k for k, i in enumerate(kept)})
                tree.seen = np.searchsorted(kept, tree.seen).astype(np.int32)
            last = prefixes[-1]
            made = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([rows["chunk"], rows["first"], rows["n"], pa.array(made, pa.binary())], ["chunk", "first", "n", "flags"])


def with_prefix(rows: DataFrame, group_size: int, at: str, most: int = 10_000) -> DataFrame:
    """Adds ``prefix``: as many of the suffix's first words as it takes until at most ``group_size`` rows share them, or SEED.

    Up to ``most`` large prefixes of a length stand in the plan as a set; beyond that they are joined.
    """
    words = lambda k: F.substring_index(F.col("right").cast("string"), " ", k)
    rows = rows.withColumn("depth", F.lit(1))
    for k in range(1, SEED):
        counts = rows.where(F.col("depth") == k).groupBy(words(k).alias("large")).agg(F.count("*").alias("c"))
        large = materialize(counts.where(F.col("c") > group_size).select("large"), f"{at}/large-{k}")
        n = large.count()
        if not n:
            break
        is_large = words(k).isin([r.large for r in large.collect()]) if n <= most else F.col("large").isNotNull()
        if n > most:
            rows = rows.join(large, (F.col("depth") == k) & (words(k) == F.col("large")), "left")
        rows = rows.withColumn("depth", F.when((F.col("depth") == k) & is_large, k + 1).otherwise(F.col("depth"))).drop("large")
    return rows.withColumn("prefix", F.expr("substring_index(cast(right as string), ' ', depth)")).drop("depth")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 20, out: str = "kept", group_size: int = 4_000, chunk_words: int = 1_000_000, filter_leaves: int = 2_000_000, spare_bits: int = 8) -> DataFrame:
    """Adds n_words, n_removed and ``out``, the kept words joined by one space.

    ``spare_bits``: bits of the filter's fingerprints beyond those that number the windows.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    if window <= SEED:
        raise ValueError(f"a window has more than {SEED} words")
    spark = docs.sparkSession
    small_batches(spark, 500)
    at = work_dir(spark, "substrings")
    docs = rereadable(docs, at)
    split = split_column()
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    bits = max(1, min(64, max(1, size // 6).bit_length() + spare_bits))
    top = min(bits, max(0, (size // 6 // filter_leaves).bit_length()))  # of the bits, those that name the group

    def send(batches):
        schema = pa.schema([("g", pa.int32()), ("chunk", pa.string()), ("leaves", pa.binary())])
        for name, rows in chunked(batches, ["split", "id", "x"], 2, chunk_words):
            leaves = Chunk([r[1] for r in rows], [r[2] for r in rows], window, bits).leaves
            cuts = np.searchsorted(leaves >> np.uint64(bits - top), np.arange(2**top + 1, dtype=np.uint64)).tolist()
            made = [(g, name, pack(leaves[a:b])) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for i in range(0, len(made), 64):
                part = made[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], schema.field(k).type) for k in range(3)], schema=schema)

    def answer(_, rows):
        names = rows["chunk"].to_pylist()
        parts = [unpack(x.as_py()) for x in rows["leaves"]]
        flags = several(parts)
        g = rows["g"][0].as_py()
        return tidied_result(pa.table({
            "chunk": names, "g": pa.array([g] * len(names), pa.int32()), "n": pa.array([len(p) for p in parts], pa.int64()),
            "total": pa.array([int(p.sum(dtype=np.uint64).astype(np.int64)) for p in parts], pa.int64()), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        }))

    def save(key_, rows):
        """One file per chunk with its answers in order of groups."""
        order = np.argsort(rows["g"].to_numpy())
        flags = [np.unpackbits(np.frombuffer(rows["bits"][i].as_py(), np.uint8), count=rows["n"][i].as_py()) for i in order.tolist()]
        total = int(rows["total"].to_numpy().astype(np.uint64).sum(dtype=np.uint64))
        all_flags = np.concatenate(flags)
        data = np.array([len(all_flags), total], "<u8").tobytes() + np.packbits(all_flags).tobytes()
        save_file(f"{at}/shared", chunk_file(key_[0].as_py()), data)
        return pa.table({"chunk": pa.array([key_[0].as_py()]), "n": pa.array([len(all_flags)], pa.int64())})

    source = docs.select(split.alias("split"), F.col(key).cast("long").alias("id"), F.col(text).alias("x"))
    sent = source.mapInArrow(tidied(send), "g int, chunk string, leaves binary")
    answers = sent.groupBy("g").applyInArrow(answer, "chunk string, g int, n long, total long, bits binary")
    answers.groupBy("chunk").applyInArrow(save, "chunk string, n long").write.parquet(f"{at}/filtered")

    def opened(name, ids, texts):
        """The chunk as it was read before, the windows that it repeats itself, and those that other chunks may have."""
        c = Chunk(ids, texts, window, bits)
        shared = np.zeros(0, bool)
        if len(c.leaves):
            data = load_file(f"{at}/shared", chunk_file(name))
            n, total = (int(x) for x in np.frombuffer(data, "<u8", 2))
            if n != len(c.leaves) or total != int(c.leaves.sum(dtype=np.uint64)):
                raise RuntimeError(f"{name} was read otherwise than before")
            shared = np.unpackbits(np.frombuffer(data, np.uint8, offset=16), count=n).astype(bool)
        return c, *c.settled(shared)

    def suffixes(batches):
        schema = pa.schema([("chunk", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
        for name, rows in chunked(batches, ["split", "id", "x"], 2, chunk_words):
            c, gone, first = opened(name, [r[1] for r in rows], [r[2] for r in rows])
            save_file(f"{at}/settled", chunk_file(name), c.note(gone, first))
            number, held = number_of(name), []
            for i, n, own, left, right in c.rows(first):
                held.append((number, i, n, own, left, right))
                if len(held) == 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    kind = "chunk long, first int, n int, id long, left binary, right binary"
    taken = materialize(source.mapInArrow(tidied(suffixes), kind), f"{at}/suffixes")
    grouped = with_prefix(taken, group_size, at).repartition("prefix").sortWithinPartitions("prefix", "id", "chunk", "first")
    flagged = grouped.select(F.col("prefix").cast("binary").alias("prefix"), "chunk", "first", "n", "left", "right").mapInArrow(tidied(lambda b: tree_rows(b, window)), "chunk long, first int, n int, flags binary")

    def save_repeats(key_, rows):
        """One file per chunk: a flag for each of its windows that passed the filter."""
        parts = sorted(zip(rows["first"].to_pylist(), rows["n"].to_pylist(), rows["flags"].to_pylist(), strict=True))
        flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for _, n, f in parts])
        save_file(f"{at}/repeats", str(key_[0].as_py()), np.array([len(flags)], "<u8").tobytes() + np.packbits(flags).tobytes())
        return pa.table({"chunk": pa.array([key_[0].as_py()], pa.int64()), "n": pa.array([len(flags)], pa.int64())})

    flagged.groupBy("chunk").applyInArrow(save_repeats, "chunk long, n long").write.parquet(f"{at}/answered")

    new = StructType.fromDDL(f"n_words long, n_removed long, {out} string")
    rest = [c for c in docs.columns if c not in (*new.names, key, text)]
    kept = StructType([*(docs.schema[c] for c in (key, *rest)), *new.fields])

    def apply(batches):
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field(c).type for c in (key, *rest)]
        for name, rows in chunked(chain([first], batches), ["_split", "_id", "_x", key, *rest], 2, chunk_words):
            c = Texts([r[1] for r in rows], [r[2] for r in rows], window)
            found = c.noted(load_file(f"{at}/settled", chunk_file(name)))
            if found is None:
                raise RuntimeError(f"{name} was read otherwise than before")
            gone, passed = found
            if len(passed):
                data = load_file(f"{at}/repeats", str(number_of(name)))
                if int(np.frombuffer(data, "<u8", 1)[0]) != len(passed):
                    raise RuntimeError(f"{name} was read otherwise than before")
                gone = np.concatenate([gone, passed[np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=len(passed)).astype(bool)]])
            # a window that the chunk repeats goes whether or not its first one stays
            flags = c.removed(gone)
            for i in range(0, len(rows), 500):
                part = range(i, min(i + 500, len(rows)))
                texts = [b" ".join([w for w, x in zip(c.tokens[j], flags[j].tolist(), strict=True) if not x] if flags[j].any() else c.tokens[j]).decode("utf-8", "surrogatepass") for j in part]
                made = [
                    *(pa.array([rows[j][3 + k] for j in part], t) for k, t in enumerate(types)),
                    pa.array([len(flags[j]) for j in part], pa.int64()), pa.array([int(flags[j].sum()) for j in part], pa.int64()), pa.array(texts, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(made, kept.names)

    again = docs.select(split.alias("_split"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_x"), *([key] + rest))
    return again.mapInArrow(tidied(apply), kept)
