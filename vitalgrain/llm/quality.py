"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the text are cut into quantile bins. Cyclic boosting visits the features in turn
and adds a shrunken tree of at most four leaves to that feature's lookup table; then the pairs whose
residuals gain most get two-dimensional tables, boosted the same way. A score is the sigmoid of an
intercept plus one table entry per feature and pair, added for a whole batch at once.

Training reads labelled rows outside the held-out fold, at most about ``sample_rows`` of them, chosen
by a hash of the id; the sample is the only data sent to the driver or broadcast. Features use the
text alone, and scoring covers every row and the whole text.

Defined results: a null text counts as empty; empty texts get a score like any other; rows of a null
id are scored and not held out; several labels of one id count as the largest; null labels are left
out; without labels of both kinds every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import add_columns, hash_sample, held_out, tidy

LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = LETTERS[26:]
SYMBOLS = b"#$%&*|<>{}[]\\/^~=+_@"
FEATURES = (
    "words", "word_length", "letters", "upper", "digits", "symbols", "shouts", "bars", "stops", "distinct",
    "top_word", "repeated_lines", "line_length", "longest", "distinct_pairs", "beyond_ascii", "short_words", "symbol_ends",
)


def text_features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, size = max(1, len(words)), max(1, len(b))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    share = lambda some: (len(b) - len(b.translate(None, some))) / size
    letters = share(LETTERS)
    seen = set(words)
    lines = [x for x in b.split(b"\n") if x]
    ends = b" ".join(words)
    symbol_ends = sum(ends.count(bytes((s, 32))) for s in b"$%&*#!|") / n
    beyond = len(b) - len(b.translate(None, bytes(range(128, 256))))
    return [
        float(np.log1p(len(words))), float(lengths.mean()), letters, share(UPPER) / max(letters, 1e-9), share(b"0123456789"), share(SYMBOLS),
        b.count(b"!") / n, b.count(b"|") / n, b.count(b".") / n, len(seen) / n,
        max(Counter(words).values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(size / max(1, len(lines)))), float(np.log1p(lengths.max())),
        len(set(zip(words, words[1:]))) / n, beyond / size, float((lengths <= 3).mean()), symbol_ends,
    ]


def _grow(g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> np.ndarray:
    """Leaf value per bin of a greedy tree over ordered bins."""
    value = -g.sum() / (h.sum() + l2)
    out = np.full(len(g), value)
    if not depth or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -1)
    cut = int(gain.argmax())
    if gain[cut] <= g.sum() ** 2 / (h.sum() + l2) + 1e-12:
        return out
    return np.concatenate([_grow(g[: cut + 1], h[: cut + 1], depth - 1, least, l2), _grow(g[cut + 1 :], h[cut + 1 :], depth - 1, least, l2)])


def _grow_pair(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> np.ndarray:
    """A tree of up to four leaves over a grid: one cut of either axis, then a cut of the other axis on each side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            made = np.empty_like(a)
            for part in (slice(0, cut), slice(cut, None)):
                made[part] = _grow(a[part].sum(0), b[part].sum(0), 1, least, l2)
            gain = -(made * a).sum() - 0.5 * (made**2 * b).sum()
            if gain > best:
                best, out = gain, made.T.copy() if turned else made
    return out


@dataclass
class Model:
    """Cut points and a table per feature; pairs (i, j) with coarse cut points and a grid."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, n_pairs: int = 6, l2: float = 1.0) -> Model:
    """Cyclic boosting of shallow trees; deterministic."""
    y = y.astype(float)
    k = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, [], [])
    if not len(y) or y.min() == y.max():
        return model
    least = 1.0
    model.cuts, model.coarse = [_quantiles(x[:, j], bins) for j in range(k)], [_quantiles(x[:, j], 8) for j in range(k)]
    fine = [np.searchsorted(model.cuts[j], x[:, j], "right") for j in range(k)]
    rough = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(k)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.intercept)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(at, p - y, size), np.bincount(at, p * (1 - p), size)

    for _ in range(rounds):
        for j in range(k):
            step = rate * _grow(*sums(fine[j], len(model.tables[j])), 2, least, l2)
            model.tables[j] += step
            z += step[fine[j]]
    gains = []
    shape = [len(c) + 1 for c in model.coarse]
    for i in range(k):
        for j in range(i + 1, k):
            g, h = sums(rough[i] * shape[j] + rough[j], shape[i] * shape[j])
            made = _grow_pair(g.reshape(shape[i], shape[j]), h.reshape(shape[i], shape[j]), least, l2)
            gains.append((-float((made.ravel() * g).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.grids = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(rounds // 5):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            at = rough[i] * shape[j] + rough[j]
            g, h = sums(at, grid.size)
            step = rate * _grow_pair(g.reshape(grid.shape), h.reshape(grid.shape), least, l2)
            grid += step
            z += step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", modulus: int = 4, sample_rows: int = 20_000) -> Model:
    """Fit on labelled rows outside the fold crc32(key) mod ``modulus`` = 2."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(~held_out("k", modulus)).dropna()
    sample = hash_sample(known, ["k", "y"], sample_rows).groupBy("k").agg(F.max("y").alias("y"))
    # the sample is bounded by sample_rows (up to the spread of the hash), so it may be broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(sample), "k")
    made = add_columns(rows, lambda: lambda ts: [[text_features(t) for t in ts]], "f array<double>", ["x"], ("x",)).toArrow()
    ids, x, y = np.array(made["k"].to_pylist()), np.array(made["f"].to_pylist()).reshape(-1, len(FEATURES)), np.array(made["y"].to_pylist())
    order = np.lexsort([*x.T, ids]) if len(ids) else []  # the same sums in any run
    model = fit(x[order], y[order]) if len(ids) else fit(x, y)
    tidy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", drops: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: the probability of label 1."""

    def make():
        return lambda texts: [model.score(np.array([text_features(t) for t in texts])).tolist()]

    return add_columns(docs, make, f"{out} double", [text], drops)
