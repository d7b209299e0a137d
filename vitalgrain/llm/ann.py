"""Approximate nearest neighbours by additive quantisation.

Unit vectors are approximated by a sum of one codeword from each of ``books`` full-dimensional
codebooks. Codebooks are fitted on the residuals of the books before, from a bounded sample of
vectors (``sample_rows``, by a hash of the row), and then refitted jointly by least squares. Every
vector is encoded by beam search over the books and stored as one byte per book plus the norm of its
approximation and its angle from the vector. A query looks up its inner products with all codewords
once; a candidate's score is the sum of its codewords' entries over the stored norm. The best ``keep``
candidates of a query in a block, its shortlist, are scored exactly in double precision from the original
vectors. So is every other one that could still be among the block's k nearest: its angle from the query
is at least that of its approximation, less the stored one. Vectors that the codes can't tell apart (near
copies, many clusters, many dimensions) make shortlists long, at worst whole blocks, and lose nothing.

Distribution: the index is cut into lists by the nearest of up to ``most_lists`` coarse centres, about
one per ``list_rows`` rows. How many lists a query visits is fitted on the sample, so that ``target``
of the true neighbours in it lie in them, for vectors of the sample and for a sample of the queries: few
lists where vectors form clusters, nearly all where they don't. A list of more than ``list_rows`` rows
(fewer where there are more than 64 dimensions) is dealt in blocks by a hash, and so are the queries
that visit it beyond ``query_rows``; a task scores one block of codes and vectors for one block of
queries, whatever the size of the table, and returns each query's k nearest of the block.

Ties in exact scores go to the smaller id; ties in approximate scores as well, so equal vectors never
push a smaller id out. Lengths don't matter, however large or small. Defined results: vectors that are null, of a length other than the commonest
one, zero, or hold null or non-finite components take no part, nor do null ids; rows that repeat id and
vector are one candidate, and each query row has a list of its own; a query never returns its own id;
fewer than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrain.llm.common import hash_sample, materialize, small_batches, tidied, work_dir

EMPTY = "query_id long, rank int, vec_id long, score double"


@dataclass
class Codebooks:
    """books x words x dim."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row by beam search, and the norms of their sums."""
        n = len(x)
        codes = np.zeros((n, 1, 0), np.uint8)
        rest = x[:, None, :]
        for book in self.words:
            square = (book**2).sum(1)
            cost = (rest**2).sum(2)[..., None] - 2 * rest @ book.T + square  # n x beams x words
            width = min(beam, cost.shape[1] * len(book))
            flat = cost.reshape(n, -1)
            pick = np.argpartition(flat, width - 1, 1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            frm, word = np.divmod(pick, len(book))
            codes = np.concatenate([np.take_along_axis(codes, frm[..., None], 1), word[..., None].astype(np.uint8)], 2)
            rest = np.take_along_axis(rest, frm[..., None], 1) - book[word]
        best = (rest**2).sum(2).argmin(1)
        codes = codes[np.arange(n), best]
        return codes, np.linalg.norm(self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.words))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        size = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def fit(x: np.ndarray, books: int = 8, words: int = 128, rounds: int = 2, beam: int = 4) -> Codebooks:
    """Residual start, then joint least-squares updates of all codewords; deterministic."""
    rng = np.random.default_rng(11)
    rest, found = x.copy(), []
    for _ in range(books):
        book = _means(rest, words, rng)
        found.append(book)
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
    made = Codebooks(np.stack(found))
    for _ in range(rounds):
        codes, _ = made.encode(x, beam)
        design = np.zeros((books * words, books * words))
        right = np.zeros((books * words, x.shape[1]))
        at = codes.astype(int) + np.arange(books) * words
        for i in range(books):
            np.add.at(right, at[:, i], x)
            for j in range(books):
                np.add.at(design, (at[:, i], at[:, j]), 1)
        design[np.diag_indices_from(design)] += 0.1
        made = Codebooks(np.linalg.solve(design, right + 0.1 * made.words.reshape(-1, x.shape[1])).reshape(made.words.shape))
    return made


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id long, v array<double>) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0))
    )


def matrix(lists) -> np.ndarray:
    """The rows of an Arrow array of lists of one length, as a matrix of its own."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).copy()


def even(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which changes no cosine: squares of their components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = even(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, one pair at a time in the same order of operations."""
    dot = np.einsum("ij,ij->i", queries, rows)
    return dot / (np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", rows, rows)))


@dataclass
class Lists:
    """Coarse centres, and how many of the nearest a query visits."""

    centres: np.ndarray
    visits: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The lists from near to far of each row."""
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argsort(1, kind="stable")


def coarse(x: np.ndarray, lists: int, k: int, target: float, tries: int = 400, queries: np.ndarray | None = None) -> Lists:
    """Centres of the sample ``x``, and the visits that reach ``target`` of the nearest neighbours in it, its own and those of ``queries``."""
    found = Lists(_means(x, lists, np.random.default_rng(12)) if lists > 1 else x[:1], 1)
    if lists < 2:
        return found
    for asked in (x[:: max(1, len(x) // tries)], *([queries] if queries is not None and len(queries) else [])):
        near = asked @ x.T
        near[near > 1 - 1e-12] = -2  # itself, and copies, which share its list
        best = np.argsort(-near, 1, kind="stable")[:, :k]
        home = found.order(x)[:, 0]
        place = (found.order(asked)[:, None, :] == home[best][..., None]).argmax(2)  # place of the neighbour's list
        found.visits = max(found.visits, int(np.quantile(place, target, method="higher")) + 1)
    return found


def shortlist(ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best scores; ``ids`` are sorted, and of equal scores the first ones stay."""
    if len(scores) <= keep:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
    pick = np.flatnonzero(scores > edge)
    return np.concatenate([pick, np.flatnonzero(scores == edge)[: keep - len(pick)]])


def nearest(scores: np.ndarray, angles: np.ndarray, slack: np.ndarray, query: np.ndarray, unit: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, keep: int):
    """(places, cosines) of the k rows nearest to a query: by its shortlist, and by every other row that could be nearer.

    ``scores``: cosines of the approximations, right to ``slack``; ``angles``: between rows and approximations; ``unit``: rows of length 1; ``own``: rows that don't count.
    """
    exact = lambda at: _exact(np.repeat(query[None], len(at), 0), rows[at])
    scores = scores.copy()
    scores[own] = -np.inf
    pick = shortlist(None, scores, keep)
    pick = pick[scores[pick] > -np.inf]
    values = exact(pick)
    left = len(scores) - len(own) - len(pick)
    if left and len(pick) >= k:
        worst = np.partition(values, len(pick) - k)[len(pick) - k]
        reach = np.arccos(np.clip(worst, -1, 1)) + 1e-7
        rest = scores + slack >= np.cos(min(np.pi, reach + angles.max()))
        rest[pick] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.arccos(np.clip(scores[rest] + slack[rest], -1, 1)) - angles[rest] <= reach]
        rest = rest[unit[rest] @ (query / np.linalg.norm(query)) >= worst - 1e-9]
        pick, values = np.concatenate([pick, rest]), np.concatenate([values, exact(rest)])
    best = np.lexsort((pick, -values))[:k]
    return pick[best], values[best]


def search(
    df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", keep: int = 256, sample_rows: int = 8_000,
    list_rows: int = 16_384, most_lists: int = 1_024, query_rows: int = 4_096, target: float = 0.98, beam: int = 4, books: int = 24,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``df`` found for each row of ``queries``."""
    import pyarrow as pa

    spark = df.sparkSession
    small_batches(spark, 4000)
    first = df.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return spark.createDataFrame([], EMPTY)
    dim = first.n
    rows = usable(df, key, vector, dim).dropDuplicates(["id", "v"])
    wanted = usable(queries, key, vector, dim)
    at = work_dir(spark, "ann")
    sample = hash_sample(rows, ["id", "v"], sample_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], EMPTY)
    x = matrix(sample["v"].combine_chunks())
    x = units(x[np.lexsort(x.T)])
    model = fit(x, books=books, words=int(min(128, max(2, len(x) // 4))))
    n_rows = rows.count()
    n_lists = int(max(1, min(n_rows // list_rows, most_lists, len(x) // 8)))
    some = units(matrix(hash_sample(wanted, ["id", "v"], 400).toArrow()["v"].combine_chunks())) if n_lists > 1 else None
    lists = coarse(x, n_lists, k, target, queries=some)
    block_rows = max(1, list_rows * 64 // max(dim, 64))

    def index(batches):
        for batch in batches:
            v = matrix(batch["v"])
            if not len(v):
                continue
            unit = units(v)
            codes, norms = model.encode(unit, beam)
            angles = np.arccos(np.clip(np.einsum("ij,ij->i", unit, model.decode(codes)) / np.maximum(norms, 1e-9), -1, 1))
            made = [pa.array(lists.order(unit)[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(angles)]
            yield pa.RecordBatch.from_arrays([batch["r"], batch["id"], batch["v"], *made], ["r", "id", "v", "list", "codes", "norm", "angle"])

    numbered = rows.withColumn("r", F.monotonically_increasing_id()).select("r", "id", "v")
    indexed = materialize(numbered.mapInArrow(tidied(index), "r long, id long, v array<double>, list int, codes binary, norm double, angle double"), f"{at}/index")

    def visit(batches):
        for batch in batches:
            v = matrix(batch["v"])
            if not len(v):
                continue
            near = lists.order(units(v))[:, : lists.visits]
            yield pa.RecordBatch.from_arrays([batch["q"], batch["id"], batch["v"], pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["q", "id", "v", "lists"])

    asked = wanted.withColumn("q", F.monotonically_increasing_id()).select("q", "id", "v")
    asked = materialize(asked.mapInArrow(tidied(visit), "q long, id long, v array<double>, lists array<int>"), f"{at}/queries")
    visits = asked.select("q", "id", "v", F.explode("lists").alias("list"))

    # sizes of the lists and of what is asked of them, at most ``most_lists`` rows
    blocks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n")).join(visits.groupBy("list").agg(F.count("*").alias("m")), "list").select("list", blocks("n", block_rows).alias("parts"), blocks("m", query_rows).alias("turns"))
    sizes = F.broadcast(materialize(sizes, f"{at}/sizes"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    codes_of = indexed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).withColumn("turn", each("turns")).drop("r", "parts", "turns")
    asked_of = visits.join(sizes, "list").withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int")).withColumn("part", each("parts")).drop("parts", "turns")

    def score(known, wanted):
        """A block of codes and vectors looked up by a block of queries: the nearest k of each."""
        out = []
        if known.num_rows and wanted.num_rows:
            order = np.argsort(known["id"].to_numpy(), kind="stable")  # equal scores keep the smaller ids
            ids = known["id"].to_numpy()[order]
            codes = np.frombuffer(b"".join(known["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = np.maximum(known["norm"].to_numpy()[order], 1e-9).astype(np.float32)
            angles = known["angle"].to_numpy()[order]
            rows = even(matrix(known["v"].combine_chunks())[order])
            unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            q, own = wanted["q"].to_numpy(), wanted["id"].to_numpy()
            v = even(matrix(wanted["v"].combine_chunks()))
            lengths = np.linalg.norm(v, axis=1, keepdims=True)
            for a in range(0, len(q), 128):
                tables = np.einsum("mwd,qd->mwq", model.words, v[a : a + 128] / lengths[a : a + 128]).astype(np.float32)
                scores = tables[0][codes[:, 0]]
                for m in range(1, codes.shape[1]):
                    scores += tables[m][codes[:, m]]
                scores = np.ascontiguousarray((scores / norms[:, None]).T)
                rounding = np.abs(tables).max(1).sum(0) * np.float32(4e-6)
                for i, s in enumerate(scores):
                    same = np.arange(np.searchsorted(ids, own[a + i]), np.searchsorted(ids, own[a + i], "right"))
                    pick, values = nearest(s, angles, rounding[i] / norms, v[a + i], unit, rows, same, k, keep)
                    out.append((np.full(len(pick), q[a + i]), np.full(len(pick), own[a + i]), ids[pick], values))
        kinds = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate([o[j] for o in out]) if out else [], t) for j, (c, t) in enumerate(kinds.items())})

    found = codes_of.groupBy("list", "part", "turn").cogroup(asked_of.groupBy("list", "part", "turn")).applyInArrow(score, "q long, query_id long, vec_id long, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
