"""N-gram Jaccard join with Bayesian candidate pruning.

A text's set is its runs of ``size`` words (all its words if it has fewer). Texts with equal sets form
one class, found by a digest; one representative of each goes on. Its MinHash signature gives bands;
representatives that share a band are candidates. Within such a bucket, pairs compare their MinHash
values step by step: after n values of which m agree, the similarity has the posterior Beta(m+1, n-m+1),
and the pair is dropped as soon as the probability of reaching the threshold falls below
``tolerance``. The pairs that are left only say which texts belong together; the groups formed by
them are then compared once more with their sets, and the same pruned pairs are verified exactly.

Large buckets and groups never meet in one task: they are cut into blocks of about ``block`` members by
a hash, and a task compares two blocks, or one with itself. Pairs stay inside the task: it returns a
count of links per text and edges of a spanning forest of its links, at most one per member.

Chances: a pair at the threshold 0.8 misses all 32 bands of 4 values with probability 5e-8, and pruning
adds at most the tolerance per step, so the links are those of an exact join but for about one in a
million at the threshold and fewer above. Similarities that are reported or counted are exact.

Defined results: null and empty texts have no set and no links and are classes of their own; rows of a
null id take part, but the class id is the smallest id that isn't null (null if there is none);
repeated rows are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import materialize, small_batches, tidied, with_row, work_dir
from vitalgrain.llm.components import components

VALUES, ROWS = 128, 4  # MinHash values; values per band
STEP = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, forgetting beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the text's distinct word runs."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out + h[k : k + len(out)] * np.uint64(2 * k + 1))
    return np.unique(out)


def signature(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits each) of a set."""
    a, b = seeds
    out = np.full(VALUES, 2**32 - 1, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    high = (hashes & np.uint64(2**32 - 1)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 512):
            x = low[None, i : i + 512] * a[:, None] + high[None, i : i + 512] * b[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            np.minimum(out, x.min(1), out=out)
    return out


def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return tuple(rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band."""
    x = sig.reshape(-1, ROWS).astype(np.uint64)
    out = np.arange(len(x), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = _mix(out * np.uint64(31) + x[:, k] + np.uint64(1))
    return out.astype(np.int64)


@lru_cache(maxsize=8)
def needed(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Agreements that a pair needs after STEP, 2 * STEP, ... values, or its posterior is below the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() / mass.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, same: bool, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks of signatures that no step drops; i < j within one block."""
    agree = np.zeros((len(left), len(right)), np.uint8)
    i, j = None, None
    for s, m in enumerate(least):
        a, b = left[:, s * STEP : (s + 1) * STEP], right[:, s * STEP : (s + 1) * STEP]
        if i is None:
            for k in range(STEP):
                agree += a[:, k, None] == b[None, :, k]
            keep = agree >= m
            if same:
                keep &= np.triu(np.ones_like(keep), 1)
            i, j = np.nonzero(keep)
            count = agree[i, j].astype(int)
        else:
            count = count + (a[i] == b[j]).sum(1)
            keep = count >= m
            i, j, count = i[keep], j[keep], count[keep]
    return i, j


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of pairs of ids: (smallest of the tree, member)."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in list(parent) if root(x) != x]


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two blocks of sorted sets, by products of 0-1 matrices."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(vocabulary), columns):
        part = vocabulary[a : a + columns]
        sides = []
        for block in (left, right):
            x = np.zeros((len(block), len(part)), np.float32)
            for r, s in enumerate(block):
                at = np.searchsorted(s, part)
                at[at == len(s)] = 0
                x[r] = s[at] == part
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _blocks(members: DataFrame, group: str, n: str, block: int) -> DataFrame:
    """One row per member and pair of blocks: group, low, high, own (the member's block)."""
    count = F.greatest(F.ceil(F.col(n) / block).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(group), "rid"), count).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("other", n)
    )


def representatives(docs: DataFrame, text: str, key: str, at: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, digest; reps: rid, digest, sig, hashes are made later). Written once."""
    import pyarrow as pa

    def make(batches):
        words, s = WordHashes(), seeds()
        import hashlib

        for batch in batches:
            digests, sigs = [], []
            for t in batch["x"].to_pylist():
                h = shingles(t, size, words)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sigs.append(signature(h, s).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], batch["th"], pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["row", "id", "th", "digest", "sig"]
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("x"))
    signed = materialize(numbered.mapInArrow(tidied(make), "row long, id long, th long, digest binary, sig binary"), f"{at}/signed")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("rid"), F.min("id").alias("first"), F.count("*").alias("copies"), F.min_by(F.struct("id", "th", "sig"), "row").alias("r")
    ).select("digest", "rid", "first", "copies", F.col("r.id").alias("rep_id"), F.col("r.th").alias("rep_th"), F.col("r.sig").alias("sig"))
    return signed.select("row", "id", "digest"), materialize(classes, f"{at}/classes")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256) -> DataFrame:
    """Per row: doc_id, class_id (smallest id linked to it, by any chain), n_links (different texts at or
    above the threshold), n_copies (other rows of equal sets), linked_rows (rows at or above it, copies included).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark, 500)
    at = work_dir(spark, "jaccard")
    members, classes = representatives(docs, text, key, at, size)
    least = needed(threshold, tolerance)

    def banded(batches):
        for batch in batches:
            b = [bands(np.frombuffer(s, np.uint32)) for s in batch["sig"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch["rid"].to_numpy(), VALUES // ROWS)), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))], ["rid", "band"]
            )

    in_bands = classes.select("rid", "sig").mapInArrow(tidied(banded), "rid long, band long")
    full = in_bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    found = materialize(in_bands.join(full, "band"), f"{at}/buckets")
    spread = _blocks(found.join(classes.select("rid", "sig"), "rid"), "band", "n", block)

    def prune(key_, batch_rows):
        sig = np.frombuffer(b"".join(batch_rows["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
        rid, own = batch_rows["rid"].to_numpy(), batch_rows["own"].to_numpy()
        low, high = key_[1].as_py(), key_[2].as_py()
        l, r = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = surviving(sig[l], sig[r], low == high, least)
        e = forest(rid[l[i]], rid[r[j]])
        return pa.table({"a": pa.array([x for x, _ in e], pa.int64()), "b": pa.array([y for _, y in e], pa.int64())})

    pairs = materialize(spread.groupBy("band", "low", "high").applyInArrow(prune, "a long, b long").distinct(), f"{at}/pruned")
    near = components(pairs, f"{at}/near")
    sizes = near.groupBy("label").agg(F.count("*").alias("n"))
    suspects = materialize(near.join(sizes, "label").select(F.col("node").alias("rid"), "label", "n"), f"{at}/suspects")

    # the suspects' sets come from their texts; id and text hash find the row of a class again
    texts = docs.select(F.col(key).cast("long").alias("rep_id"), F.xxhash64(text).alias("rep_th"), F.col(text).alias("x"))
    wanted = suspects.join(classes.select("rid", "copies", "rep_id", "rep_th"), "rid")
    same_row = wanted["rep_id"].eqNullSafe(texts["rep_id"]) & (wanted["rep_th"] == texts["rep_th"])

    def sets(batches):
        words, s = WordHashes(), seeds()
        for batch in batches:
            h = [shingles(t, size, words) for t in batch["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["label"], batch["n"], batch["copies"], pa.array([x.tobytes() for x in h], pa.binary()), pa.array([signature(x, s).tobytes() for x in h], pa.binary())],
                ["rid", "label", "n", "copies", "hashes", "sig"],
            )

    with_sets = (
        texts.join(wanted, same_row)
        .select("rid", "label", "n", "copies", "x")
        .dropDuplicates(["rid"])
        .mapInArrow(tidied(sets), "rid long, label long, n long, copies long, hashes binary, sig binary")
    )

    def verify(key_, batch_rows):
        sig = np.frombuffer(b"".join(batch_rows["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
        sets_ = [np.frombuffer(x, np.uint64) for x in batch_rows["hashes"].to_pylist()]
        rid, own, copies = batch_rows["rid"].to_numpy(), batch_rows["own"].to_numpy(), batch_rows["copies"].to_numpy()
        low, high = key_[1].as_py(), key_[2].as_py()
        l, r = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = surviving(sig[l], sig[r], low == high, least)
        if len(i):
            us, u = np.unique(i, return_inverse=True)
            vs, v = np.unique(j, return_inverse=True)
            a, b = [sets_[l[x]] for x in us], [sets_[r[x]] for x in vs]
            both = intersections(a, b)[u, v]
            size_a, size_b = np.array([len(x) for x in a])[u], np.array([len(x) for x in b])[v]
            linked = both >= threshold * (size_a + size_b - both) - 1e-9
            i, j = l[i[linked]], r[j[linked]]
        links = np.zeros(len(rid), np.int64)
        rows = np.zeros(len(rid), np.int64)
        for x, y in ((i, j), (j, i)):
            np.add.at(links, x, 1)
            np.add.at(rows, x, copies[y])
        e = forest(rid[i], rid[j]) if len(i) else []
        k = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([x for x, _ in e] + rid[k].tolist(), pa.int64()), "b": pa.array([y for _, y in e] + [None] * len(k), pa.int64()),
            "links": pa.array([None] * len(e) + links[k].tolist(), pa.int64()), "rows": pa.array([None] * len(e) + rows[k].tolist(), pa.int64()),
        })

    verified = materialize(
        _blocks(with_sets, "label", "n", block).groupBy("label", "low", "high").applyInArrow(verify, "a long, b long, links long, rows long"), f"{at}/verified"
    )
    linked = components(verified.where("b IS NOT NULL").select("a", "b"), f"{at}/linked")
    counts = verified.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("n_links"), F.sum("rows").alias("near_rows"))
    ids = classes.select("rid", "digest", "first", "copies").join(linked.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    least_id = ids.groupBy("label").agg(F.min("first").alias("class_id"))
    known = ids.join(least_id, "label").join(counts, "rid", "left").select("digest", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("near_rows", F.lit(0)).alias("near_rows"))
    return members.join(known, "digest", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_copies"),
        (F.coalesce("near_rows", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("linked_rows"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row of each class: the one with the smallest id, of equal ids the first; null ids come last."""
    rows, row = with_row(docs)
    found = join(rows, key=row, **options).where("linked_rows > 0").select(F.col("doc_id").alias(row), "class_id")
    members = found.join(rows.select(row, F.col(key).alias("_id")), row)
    kept = members.groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", row)).alias("m")).select(F.col(f"m.{row}").alias(row))
    gone = found.select(row).join(kept, row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
