"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are white-space words with A-Z lower-cased, then one end token. Counts are taken over all
training texts by a distributed sum. The frequent ``classes`` words are classes of the model; every
other word belongs to one of ``buckets`` classes by its last two bytes, within which it has its
smoothed share of counts. The model predicts the next class from the ``context`` classes before it:
a linear map per place, summed, times the class vectors, plus a bias. It is trained in numpy with
noise drawn from the exact class counts; scoring normalises over all classes by batched matrix
products, so class and word probabilities sum to one over known words and one unknown word per bucket.

Training reads every training document. A first group of about ``sample_docs`` documents gives the
starting weights; all others are dealt by a hash of id and text to groups of about that size, whose
number grows with the input. Each group is streamed through a task of its own, from the weights so
far, and the groups' weights are averaged by tokens after each of ``rounds`` rounds.

Distribution: the most frequent words, at most ``head``, go to every task with their counts; other words of a text leave it as (word, times) and meet their counts in a shuffle join.
No such word can be hot, as every hot word is in the head. The rows are written once to the shared
folder with their classes, so that their row ids hold and training and scoring split no text again.

Defined results: a null text counts as empty, which is the end token alone; a null id is a training
row; repeated rows are scored one by one; an empty table gives no rows; without training rows every
count is 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vitalgrain.llm.common import held_out, materialize, small_batches, tidied, work_dir

END = b""  # no word is empty
LOG10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words and the end token, as UTF-8."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-2:]) % buckets


def bucket_column(word: str, buckets: int):
    w = F.col(word)
    return F.pmod(F.crc32(F.substring(w, F.greatest(F.octet_length(w) - 1, F.lit(1)), F.lit(2))), F.lit(buckets)).cast("int")


def count_words(texts: DataFrame, most: int = 250_000) -> DataFrame:
    """(word, n) over the column ``x``; each task keeps at most about ``most`` words at a time."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        found: Counter = Counter()

        def flush():
            keys = list(found)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[k] for k in part], pa.int64())], schema=schema)
            found.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
                if len(found) > most:
                    yield from flush()
        yield from flush()

    return texts.select("x").mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words above the lowest count that at most ``most`` words reach, most frequent first.

    The count is found from sums over classes of counts, so no task sorts more than it holds.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some thousands of rows at most
        if taken + r.n > most:
            break
        taken, least = taken + r.n, r.b
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(step >= least).toArrow()
    pairs = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return [w for _, w in pairs], np.array([n for n, _ in pairs], np.int64)


@dataclass
class Model:
    """Projected context vectors per place (the last row is "before the text"), class vectors and biases."""

    context: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def log_probs(self, classes: np.ndarray, starts: np.ndarray, block: int = 2048) -> np.ndarray:
        """Natural log probability of each class given those before it in its text; starts: place of each one's text start.

        Where no score can leave the range of ``exp``, which the lengths of vectors tell, the largest one needs no taking off.
        """
        before = len(self.bias)
        at = np.arange(len(classes))
        out = np.empty(len(classes), np.float64)
        columns = np.ascontiguousarray(np.concatenate([self.out, self.bias[:, None]], 1).T, np.float32)
        longest, most = float(np.sqrt((self.out**2).sum(1).max())), float(np.abs(self.bias).max())
        v = np.ones((block, len(columns)), np.float32)
        scores, ones = np.empty((block, before), np.float32), np.ones(before, np.float32)
        for a in range(0, len(classes), block):
            b = min(a + block, len(classes))
            n, own = b - a, classes[a:b]
            summed = np.zeros((n, len(columns) - 1), np.float32)
            for k, table in enumerate(self.context, 1):
                i = at[a:b] - k
                summed += table.take(np.where(i >= starts[a:b], classes.take(i, mode="wrap"), before), 0)
            v[:n, :-1] = summed
            z = np.matmul(v[:n], columns, out=scores[:n])
            picked = z[np.arange(n), own].astype(np.float64)
            if float(np.sqrt(np.einsum("ij,ij->i", summed, summed).max())) * longest + most > 60:
                top = z.max(1)
                z -= top[:, None]
                picked -= top
            np.exp(z, out=z)
            out[a:b] = picked - np.log(np.matmul(z, ones))
        return out


def new_state(counts: np.ndarray, context: int = 4, size: int = 24) -> list[np.ndarray]:
    """Starting weights (context vectors, class vectors, biases, maps), then Adagrad's squares of each."""
    rng = np.random.default_rng(7)
    n = len(counts)
    bias = np.log((counts + 0.5) / (counts.sum() + 0.5 * n))
    params = [rng.normal(0, 0.1, (n + 1, size)), rng.normal(0, 0.1, (n, size)), bias, np.stack([np.eye(size) * 0.5] * context)]
    return [x.astype(np.float32) for x in params] + [np.full(x.shape, 1e-4, np.float32) for x in params]


def _summed(at: list[np.ndarray], values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by each of ``at``, one count over all cells for each."""
    size = values.shape[1]
    flat, steps = values.ravel().astype(np.float64), np.arange(size)
    return np.stack([np.bincount((i[:, None] * size + steps).ravel(), flat, n * size) for i in at]).reshape(len(at), n, size).astype(np.float32)


def learn_texts(state: list[np.ndarray], texts: list[np.ndarray], counts: np.ndarray, rng, epochs: int = 1, noise: int = 96, rate: float = 0.08, batch: int = 512) -> None:
    """Noise-contrastive estimation on texts of classes, changing ``state``; ``counts`` gives the noise."""
    if not texts:
        return
    rows, out, bias, maps = params = state[:4]
    squares, context, n = state[4:], len(maps), len(counts)
    q = (counts + 0.5) / (counts.sum() + 0.5 * n)
    steps = np.cumsum(q)
    log_qk = (np.log(q) + np.log(12)).astype(np.float32)  # noise draws per token that the shared ones stand for
    joined = np.concatenate([np.concatenate([np.full(context, n), t]) for t in texts])
    own_at = np.ones(len(joined), bool)
    begins = np.cumsum([0] + [len(t) + context for t in texts[:-1]])
    own_at[(begins[:, None] + np.arange(context)).ravel()] = False
    places = np.flatnonzero(own_at)
    for _ in range(epochs):
        order = rng.permutation(places)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            y, h = joined[pick], [joined[pick - k] for k in range(1, context + 1)]
            drawn = np.minimum(np.searchsorted(steps, rng.random(noise)), n - 1)
            projected = np.matmul(rows, maps)
            v = projected[0].take(h[0], 0)
            for table, i in zip(projected[1:], h[1:], strict=True):
                v += table.take(i, 0)
            drawn_out, own_out = out.take(drawn, 0), out.take(y, 0)
            own = np.einsum("ij,ij->i", v, own_out) + bias[y] - log_qk[y]
            other = v @ -drawn_out.T
            other += log_qk[drawn] - bias[drawn]
            d_own = -1 / (1 + np.exp(np.minimum(own, 80)))
            with np.errstate(over="ignore"):  # one over infinity is 0
                np.exp(other, out=other)
            other += 1
            d_other = np.divide(np.float32(12 / noise), other, out=other)
            dv = d_own[:, None] * own_out
            dv += d_other @ drawn_out
            g_out, g_bias = _summed([y], d_own[:, None] * v, n)[0], np.bincount(y, d_own, n).astype(np.float32)
            np.add.at(g_out, drawn, d_other.T @ v)
            np.add.at(g_bias, drawn, d_other.sum(0))
            # gradients of the projected vectors, of all places at once
            by_class = _summed(h, dv, n + 1)
            g_rows = np.matmul(by_class, maps.transpose(0, 2, 1)).sum(0)
            g_maps = np.matmul(rows.T, by_class)
            for p, s, g in zip(params, squares, [g_rows, g_out, g_bias, g_maps], strict=True):  # Adagrad
                g /= len(pick)
                s += g * g
                p -= rate * g / np.sqrt(s)


def model_of(state: list[np.ndarray]) -> Model:
    rows, out, bias, maps = state[:4]
    return Model([rows @ m for m in maps], out, bias)


def train_model(texts: list[np.ndarray], counts: np.ndarray, context: int = 4, size: int = 24, epochs: int = 3) -> Model:
    """A model of the given texts. Deterministic."""
    state = new_state(counts, context, size)
    learn_texts(state, texts, counts, np.random.default_rng(7), epochs)
    return model_of(state)


def train_all(texts: DataFrame, counts: np.ndarray, kind: str, context: int, group_docs: int, rounds: int = 4, epochs: int = 3) -> Model:
    """A model of all rows (h, classes): ``h`` hashes the row, ``classes`` are its classes as bytes of type ``kind``.

    Groups and their order follow from the rows, not from how they lie in partitions.
    """
    import pyarrow as pa

    state = new_state(counts, context)
    n_rows = texts.count()
    every = max(1, -(-n_rows // group_docs))
    weights = "part int, tokens double, state binary"
    schema = pa.schema([("part", pa.int32()), ("tokens", pa.float64()), ("state", pa.binary())])

    def pack(xs) -> bytes:
        return b"".join(x.tobytes() for x in xs)

    def unpack(b: bytes) -> list[np.ndarray]:
        ends = np.cumsum([x.size for x in state])
        return [x.reshape(y.shape).copy() for x, y in zip(np.split(np.frombuffer(b, np.float32), ends[:-1]), state, strict=True)]

    def rounds_of(part: DataFrame, groups: int, passes: int):
        start = pack(state)

        def one(batches):
            from pyspark import TaskContext

            at = TaskContext.get().partitionId()
            own, rng, tokens = unpack(start), np.random.default_rng(at), 0
            held, size = [], 0
            for batch in batches:
                for x in batch["classes"].to_pylist():
                    held.append(np.frombuffer(x, kind).astype(np.int64))
                    size += len(held[-1])
                    if size > 500_000:
                        learn_texts(own, held, counts, rng, passes)
                        held, size, tokens = [], 0, tokens + size
            learn_texts(own, held, counts, rng, passes)
            if tokens + size:
                yield pa.RecordBatch.from_pylist([{"part": at, "tokens": float(tokens + size), "state": pack(own)}], schema)

        def mean(table):
            rows = sorted(table.select(["part", "tokens", "state"]).to_pylist(), key=lambda r: r["part"])
            total = sum(r["tokens"] for r in rows)
            out = sum(np.frombuffer(r["state"], np.float32) * (r["tokens"] / total) for r in rows)
            return pa.Table.from_pylist([{"part": rows[0]["part"], "tokens": total, "state": out.astype(np.float32).tobytes()}], schema)

        made = part.repartition(groups, "h").sortWithinPartitions("h", "classes").select("classes").mapInArrow(tidied(one), weights)
        # at most 16 sets of weights reach the driver
        few = made.groupBy(F.pmod("part", F.lit(16))).applyInArrow(mean, weights).toArrow() if groups > 16 else made.toArrow()
        if few.num_rows:
            state[:] = unpack(mean(few)["state"][0].as_py())

    if not n_rows:
        return model_of(state)
    first = F.pmod("h", F.lit(every)) == 0
    rounds_of(texts.where(first), 1, epochs)
    if every > 1:
        rounds = min(rounds, every - 1)
        turn = F.pmod(F.xxhash64("h"), F.lit(rounds))
        for r in range(rounds):
            rounds_of(texts.where(~first & (turn == r)), max(1, -(-(every - 1) // rounds)), 1)
    return model_of(state)


class Index(dict):
    """Word -> place in the head, -1 elsewhere."""

    def __missing__(self, word: bytes) -> int:
        return -1


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", modulus: int = 7, classes: int = 320, buckets: int = 32, head: int = 200_000, sample_docs: int = 1_500, context: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) per row."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    at = work_dir(spark, "lm")
    rows = docs.select(F.col(key).alias("k"), held_out(key, modulus).alias("held_out"), F.col(text).alias("x"))
    learn = rows.where(~F.col("held_out"))
    counts = materialize(count_words(learn), f"{at}/counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary, head_n = frequent(counts, head)
    # sums per bucket of the words that aren't classes of their own
    sums = np.zeros((buckets, 2))
    for r in counts.groupBy(bucket_column("word", buckets).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[r.b] = r.n, r.v
    for w, c in zip(vocabulary[:classes], head_n[:classes].tolist(), strict=True):
        sums[bucket_of(w, buckets)] -= c, 1
    own = min(classes, len(vocabulary))
    head_class = np.array([i if i < own else own + bucket_of(w, buckets) for i, w in enumerate(vocabulary)], np.int64)
    class_counts = np.concatenate([head_n[:own], sums[:, 0]]).astype(float)
    bucket_log = np.log10(sums.sum(1) + 1)

    shared = spark.sparkContext.broadcast((vocabulary, head_n, head_class, bucket_log))  # bounded by head
    code = "u2" if own + buckets < 1 << 16 else "i4"

    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))
    schema = pa.schema(
        [("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("inner", pa.float64()), ("classes", pa.binary()), ("tail", tail_type)]
    )

    def run(batches):
        vocabulary, head_n, head_class, bucket_log = shared.value
        index = Index(zip(vocabulary, range(len(vocabulary)), strict=True))
        # the last entries stand for words beyond the head
        head_log = np.append(np.log10(head_n + 1.0), 0.0)
        class_of = np.append(head_class, 0)
        class_log = np.concatenate([np.zeros(own), bucket_log])
        for batch in batches:
            done = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                found, logs = class_of[ids], head_log[ids]
                rare = np.flatnonzero(ids < 0).tolist()
                for i in rare:
                    found[i] = own + bucket_of(words[i], buckets)
                tail = Counter(words[i] for i in rare)
                # a word's share of its class; words beyond the head add their count after the join
                inner = float(logs[found >= own].sum() - class_log[found].sum())
                done.append({
                    "row": row, "n_tokens": len(words), "known": len(words) - len(rare), "logs": float(logs.sum()), "inner": inner,
                    "classes": found.astype(code).tobytes(), "tail": [{"word": w, "times": n} for w, n in tail.items()],
                })
            yield pa.RecordBatch.from_pylist(done, schema)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "k", "held_out", F.xxhash64("k", "x").alias("h"), "x")
    kind = "row long, n_tokens long, known long, logs double, inner double, classes binary, tail array<struct<word:binary,times:int>>"
    # ids and flags pass beside the text, so that one scan makes everything
    coded = materialize(_beside(numbered, run, kind), f"{at}/coded")
    shared.destroy()
    model = train_all(coded.where(~F.col("held_out")).select("h", "classes"), class_counts, code, context, sample_docs)

    def scores(batches):
        for batch in batches:
            values = []
            for a in range(0, batch.num_rows, 64):
                found = [np.frombuffer(x, code).astype(np.int64) for x in batch["classes"][a : a + 64].to_pylist()]
                sizes = np.array([len(x) for x in found])
                starts = np.cumsum(sizes) - sizes
                p = model.log_probs(np.concatenate(found), np.repeat(starts, sizes))
                values += (np.add.reduceat(p, starts) / LOG10).tolist()  # no text is without its end token
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(values, pa.float64())], [*rest, "model"])

    plain = coded.drop("h", "tail")
    rest = [c for c in plain.columns if c != "classes"]
    scored = plain.mapInArrow(tidied(scores), StructType([*plain.select(*rest).schema.fields, StructField("model", DoubleType())]))
    tail = (
        coded.select("row", F.explode("tail").alias("t"))
        .select("row", "t.word", "t.times")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("tail_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("tail_logs"))
    )
    n_all, scale = int(total.n), float(np.log10(total.n + total.v + 1))
    return scored.join(tail, "row", "left").select(
        F.col("k").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("model") + F.col("inner") + F.coalesce("tail_logs", F.lit(0.0))).alias("score"),
    )


def _beside(numbered: DataFrame, run, kind: str) -> DataFrame:
    """Run over (row, x) and give the columns k, held_out and h back to the results, in one pass and in order."""
    import pyarrow as pa
    made = StructType.fromDDL(kind)
    schema = StructType([*numbered.select("k", "held_out", "h").schema.fields, *made.fields])

    def both(batches):
        waiting: list[pa.RecordBatch] = []
        taken = 0

        def feed():
            for batch in batches:
                waiting.append(batch.select(["k", "held_out", "h"]))
                yield batch.select(["row", "x"])

        for out in run(feed()):
            need, parts = out.num_rows, []
            while need:
                head = waiting[0]
                part = head.slice(taken, need)
                parts.append(part)
                need -= part.num_rows
                taken += part.num_rows
                if taken == head.num_rows:
                    waiting.pop(0)
                    taken = 0
            if parts:
                side = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*side.columns, *out.columns], [*side.schema.names, *out.schema.names])

    return numbered.mapInArrow(tidied(both), schema)
