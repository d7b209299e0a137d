"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units behind a number and capitalised names in mid-sentence
turn into typed placeholders, neighbouring names into one; anything else is lower-cased and loses its punctuation. Every
run of ``window`` template tokens of a benchmark item (the whole item if it is shorter) is a window.
Documents and items are joined on the hashes of their windows. A hit counts if the template tokens
agree and its slots are consistent: equal values of the item stand opposite equal values of the
document and different ones opposite different ones, so a question with new numbers or names is
caught, while a chance meeting of placeholders is not. That holds over the passage: windows that lie
at one distance of document and item are looked at together, and where their slots don't fit one to one, only those count that
have the item's own values.

Item windows (two longs each) reach the scan as a filter if there are at most ``filter_windows`` of
them; beyond that the scan passes all windows on. Either way the hits are settled by the same hash
join, which Spark shuffles if the item side is large. Tokens of a hit travel with it, so that it is
compared in full. Windows of which half or more are numbers and names, and items of fewer than ``least``
tokens, say too little as templates and have to agree word for word.

Defined results: null and empty texts have no windows, nor do texts without letters and digits; ``find`` names no document of a null id, ``remove`` goes by row; repeated items or documents give the result of one; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import materialize, small_batches, tidied, with_row, work_dir

#: Units that count as a slot behind a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "ml", "l", "s", "sec", "min", "h", "hr", "hrs", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "usd", "eur", "mph", "kmh", "w", "kw", "v", "a", "hz", "c", "f",
    "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter", "centimeters", "inch", "inches", "foot", "feet", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "watt", "watts", "volt", "volts",
)
PLAIN, NUMBER, NAME, UNIT = range(4)
MARKS = ("", "<number>", "<name>", "<unit>")
RAW = 2  # the form of a window that has its tokens as they are
ODD = 0x9E3779B97F4A7C15  # multiplier of the word hash; odd, so it has an inverse

_UNIT_SET = frozenset(UNITS)
_GLUED = re.compile(rb"[^0-9a-z\x80-\xff]*[0-9][0-9.,]*([a-z]+)[^0-9a-z\x80-\xff]*")
_CODES = np.arange(256)
_SPACE = np.isin(_CODES, [9, 10, 11, 12, 13, 32])
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_KEPT = _DIGIT | _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_ENDS = np.isin(_CODES, list(b".!?:"))
_LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, modulo 2 ** 64."""
    both = []
    for base in (ODD, pow(ODD, -1, 2**64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return tuple(both)


class Tokens:
    """The template tokens of some texts, found with array operations over their joined bytes.

    A word keeps its letters, digits and bytes beyond ASCII, in lower case (ASCII and Latin-1); a word
    of which nothing is left is no token.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        upper = _UPPER[buf]
        low = _LOWER[buf]
        accents = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))
        low[accents + 1] += 0x20
        upper[accents] = True
        small = (buf >= 97) & (buf <= 122)
        small[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x9F) & (buf[1:] != 0xB7)
        kept, inside = _KEPT[buf], ~_SPACE[buf]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.buffer, self.low = buf, low
        if not len(first):
            self.raw, self.docs, self.spans = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
            self.kinds = self.open_kinds = np.zeros(0, np.int8)
            self.hashes = self.open_hashes = self.raw
            self.starts = [np.zeros(0, np.int64)] * 3
            return
        first, last = self._split_units(first, last, kept)
        count = np.concatenate([[0], np.cumsum(kept)])
        before, size = count[first], count[last] - count[first]
        room = 1 << int(len(buf) + 1).bit_length()
        up, down = _powers(room)
        with np.errstate(over="ignore"):
            terms = (low.astype(np.uint64) + np.uint64(1)) * up[count[:-1]]
            terms[~kept] = 0
            hashes = _mix(np.add.reduceat(terms, first) * down[before] + size.astype(np.uint64))
        digits = np.add.reduceat(_DIGIT[buf].astype(np.int32), first)
        smalls = np.add.reduceat(small.astype(np.int32), first)
        letters = np.append(np.flatnonzero(kept), 0)
        docs = np.searchsorted(begins, first, "right") - 1
        start = np.ones(len(first), bool)
        start[1:] = _ENDS[buf[last[:-1] - 1]] | (docs[1:] != docs[:-1])
        number = (size > 0) & (digits == size)
        capital = upper[letters[before]] & (size > 1) & (smalls > 0) & ~number
        there = size > 0
        self.docs, self.spans = docs[there], np.stack([first[there], last[there]], 1)
        self.raw = hashes[there]
        made = []
        for name in (capital & ~start, capital):
            kinds = np.where(number, NUMBER, np.where(name, NAME, PLAIN)).astype(np.int8)[there]
            after = np.flatnonzero((kinds[:-1] == NUMBER) & (self.docs[1:] == self.docs[:-1])) + 1
            if len(after):
                kinds[after[np.isin(self.raw[after], _unit_hashes()) & (kinds[after] == PLAIN)]] = UNIT
            made += [kinds, np.where(kinds == PLAIN, self.raw, _mark_hashes()[kinds])]
        self.kinds, self.hashes, self.open_kinds, self.open_hashes = made
        more = np.zeros(len(self.raw), bool)
        more[1:] = (self.kinds[1:] == NAME) & (self.kinds[:-1] == NAME) & (self.docs[1:] == self.docs[:-1])
        #: of each form, where its tokens begin among the words: neighbouring names are one token, in both templates alike
        self.starts = [np.flatnonzero(~more)] * 2 + [np.arange(len(self.raw))]

    def _split_units(self, first: np.ndarray, last: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' edges, with a number and the unit glued to it as two words."""
        digit = _DIGIT[self.buffer]
        turns = np.flatnonzero(digit[:-1] & kept[1:] & ~digit[1:]) + 1
        word = np.searchsorted(first, turns, "right") - 1
        ends, cuts = last[word], []
        for t, a, b in zip(turns.tolist(), first[word].tolist(), ends.tolist(), strict=True):
            if b - t < 12 and t - a < 40 and (m := _GLUED.fullmatch(self.low[a:b].tobytes())) and m.start(1) + a == t and m[1].decode() in _UNIT_SET:
                cuts.append(t)
        if not cuts:
            return first, last
        return np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))

    def windows(self, size: int, form: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each run of ``size`` tokens of one text.

        Forms: 0 template, 1 template in which capitalised words are names wherever they stand, both
        without runs of which half or more are numbers and names; 2 the tokens themselves.
        """
        starts = self.starts[form]
        tokens = (self.hashes, self.open_hashes, self.raw)[form][starts]
        kinds = (self.kinds, self.open_kinds, np.zeros(len(self.kinds), np.int8))[form][starts]
        docs = self.docs[starts]
        n = len(tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.full(n, size + (form == RAW) * 1000, np.uint64)
        up = _powers(64)[0]
        with np.errstate(over="ignore"):
            for k in range(size):
                out += tokens[k : k + n] * up[k + 1]
            out = _mix(out)
        slots = np.concatenate([[0], np.cumsum((kinds == NUMBER) | (kinds == NAME))])
        at = np.flatnonzero((docs[:n] == docs[size - 1 :]) & ((slots[size:] - slots[:-size]) * 2 < size))
        return at, out[at].astype(np.int64)

    def word(self, i: int) -> str:
        a, b = self.spans[i].tolist()
        return self.low[a:b][_KEPT[self.buffer[a:b]]].tobytes().decode("utf-8", "replace")

    def template(self, at: int, size: int, form: int = 0) -> tuple[str, list[str]]:
        """The window's template and the values of its slots."""
        starts = self.starts[form]
        edges = [*starts[at : at + size].tolist(), int(starts[at + size]) if at + size < len(starts) else len(self.raw)]
        kinds = (self.kinds, self.open_kinds, np.zeros(len(self.raw), np.int8))[form][starts[at : at + size]].tolist()
        words = [" ".join(self.word(i) for i in range(a, b if k == NAME else a + 1)) for a, b, k in zip(edges[:-1], edges[1:], kinds, strict=True)]
        if form == RAW:
            return "= " + " ".join(words), []
        return " ".join(MARKS[k] or w for w, k in zip(words, kinds, strict=True)), [w for w, k in zip(words, kinds, strict=True) if k]


@lru_cache(maxsize=1)
def _unit_hashes() -> np.ndarray:
    return np.sort(Tokens([" ".join(UNITS)]).hashes)


@lru_cache(maxsize=1)
def _mark_hashes() -> np.ndarray:
    return _mix(np.arange(1, 5, dtype=np.uint64))


def batches_of(ids: list, texts: list, most: int = 1 << 20):
    """(ids, texts) of about a megabyte of text each."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) if t else 0
        if n > most:
            yield ids[a : i + 1], texts[a : i + 1]
            a, n = i + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 10, least: int = 5, filter_windows: int = 1_000_000) -> DataFrame:
    """Pairs (doc_id, item_id) with n_windows, the item's distinct windows found, and item_windows, those it has."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    kind = "hash long, size int, template string, values array<string>, part long, spot int"

    def forms(size):
        return (0, 1, RAW) if size >= least else (RAW,)

    def explode_items(batches):
        schema = pa.schema([("item_id", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("template", pa.string()), ("values", pa.list_(pa.string())), ("part", pa.int64()), ("spot", pa.int32())])
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"].to_pylist(), batch["x"].to_pylist(), strict=True):
                toks = Tokens([t])
                sizes = [min(window, len(s)) for s in toks.starts]
                if not sizes[RAW]:
                    continue
                # a window's part in the item: its template, or its tokens where the template says too little
                parts = dict(zip(*(x.tolist() for x in toks.windows(sizes[RAW], RAW)), strict=True))
                if sizes[0] >= least:
                    at, h = toks.windows(sizes[0])
                    parts |= dict(zip(toks.starts[0][at].tolist(), h.tolist(), strict=True))
                for form in (f for f in (0, 1, RAW) if f == RAW or sizes[f] >= least):
                    for i, h in zip(*(x.tolist() for x in toks.windows(sizes[form], form)), strict=True):
                        template, values = toks.template(i, sizes[form], form)
                        rows.append({"item_id": k, "hash": h, "size": sizes[form], "template": template, "values": values, "part": parts.get(int(toks.starts[form][i]), h), "spot": i})
            yield pa.RecordBatch.from_pylist(rows, schema)

    items = materialize(
        benchmark.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("x"))
        .mapInArrow(explode_items, f"item_id long, {kind}")
        .dropDuplicates(["item_id", "hash", "template", "values", "part", "spot"]),
        f"{work_dir(spark, 'items')}/windows",
    )
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most window values
    n_windows = items.count()
    known = None
    if n_windows <= filter_windows:
        known = np.sort(np.array(items.select("hash").distinct().toArrow()["hash"].to_pylist(), np.int64))
    low_bits = (1 << 22) - 1

    def scan(batches):
        bits = None
        if known is not None:
            bits = np.zeros(low_bits + 1, bool)
            bits[known & low_bits] = True
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("template", pa.string()), ("values", pa.list_(pa.string())), ("spots", pa.list_(pa.int32()))])
        for batch in batches:
            for ids, texts in batches_of(batch["k"].to_pylist(), batch["x"].to_pylist()):
                toks, out = Tokens(texts), []
                for size in sizes:
                    for form in forms(size):
                        seen: dict = {}
                        at, h = toks.windows(size, form)
                        if bits is not None:
                            some = np.flatnonzero(bits[h & low_bits])
                            some = some[np.isin(h[some], known)]
                            at, h = at[some], h[some]
                        for i, x, d in zip(at.tolist(), h.tolist(), toks.docs[toks.starts[form][at]].tolist(), strict=True):
                            if ids[d] is None:
                                continue
                            template, values = toks.template(i, size, form)
                            spots = seen.setdefault((d, template, tuple(values)), [])
                            if not spots:
                                out.append({"doc_id": ids[d], "hash": x, "template": template, "values": values, "spots": spots})
                            spots.append(i)
                yield pa.RecordBatch.from_pylist(out, schema)

    hits = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x")).mapInArrow(tidied(scan), "doc_id long, hash long, template string, values array<string>, spots array<int>")
    own = items.withColumnRenamed("values", "item_values")
    pair = F.array_distinct(F.arrays_zip(F.col("item_values").alias("a"), F.col("values").alias("b")))

    def one_to_one(pairs):
        return (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))))

    totals = items.groupBy("item_id").agg(F.count_distinct("part").alias("item_windows"))
    fits = hits.join(own, ["hash", "template"]).withColumn("pairs", pair)
    # of one item at one distance there are no more windows than the item has
    passages = (
        fits.select("doc_id", "item_id", "part", "pairs", (F.col("values") == F.col("item_values")).alias("same"), F.explode("spots").alias("at"), "spot")
        .groupBy("doc_id", "item_id", (F.col("at") - F.col("spot")).alias("distance"))
        .agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set("part").alias("parts"), F.collect_set(F.when(F.col("same"), F.col("part"))).alias("own"))
    )
    return (
        passages.select("doc_id", "item_id", F.explode(F.when(one_to_one(F.col("pairs")), F.col("parts")).otherwise(F.col("own"))).alias("part"))
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("part").alias("n_windows"))
        .join(totals, "item_id")
        .select("doc_id", "item_id", "n_windows", "item_windows")
    )


def contaminated(pairs: DataFrame, share: float = 0.5, windows: int = 3) -> DataFrame:
    """The pairs in which a document holds enough of an item: a share of its windows, or a few of them."""
    return pairs.where((F.col("n_windows") >= windows) | (F.col("n_windows") >= share * F.col("item_windows")))


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows without those that hold benchmark items, whatever their id."""
    rows, row = with_row(docs)
    bad = contaminated(find(rows, benchmark, key=row, **options)).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
