"""Information-theoretic sanitisation: personal data by fixed patterns, and terms that reveal it by corpus co-occurrence.

What the patterns find are the protected entities. A term is a word of a document, in lower case and without
punctuation around it. Over the whole corpus of N documents it is counted in how many an entity e occurs, in how
many a term t occurs, and in how many t stands within ``WINDOW`` words of e. With the information of an entity,
IC(e) = log2(N / n_e), and the pointwise mutual information PMI(t; e) = IC(e) + log2(n_te / n_t), a term discloses
the share PMI / IC of the entity. Terms that disclose at least ``disclosed``, in at least ``contexts`` different
surroundings (so copies of one text count once), are sensitive in the documents that hold the entity: a term is
generalised (a number to its first digit and length, a word to its first two letters) if its class, by the same
statistics, discloses less than that; else it is removed.

Jobs: one scan gives (entity, term, surroundings) rows around entities, summed up before and after the shuffle; a
second counts the candidates among them over all documents (partial sums per task); the last one marks the spans. What tasks get as a
whole is counted first: up to ``MOST_KEYS`` candidates or rules. Beyond that all words are counted and joined with
the candidates, and rules reach documents by a join on their entities; the results are the same.

Defined results: a null text is empty and has no spans; spans count code points, end exclusive, and go by kind as in
``KINDS`` and then by start; base spans stay as the patterns give them, also where they overlap; added spans never
touch one; repeated rows count as documents of their own; an empty table gives no rows; a document without an entity
has no span at all; columns of ``docs`` stay, one of the output's name gives way.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import add_columns, free_name, materialize, small_batches, tidied, with_row, work_dir

#: Kinds in their order, and the patterns' alphabets.
KINDS = ("email", "ip", "card", "phone", "general", "removed")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‘’«»…–—¿¡"
NUMBER = re.compile(r"[0-9][0-9.,]*")
ANY = b""
WINDOW, MOST_KEYS, FLUSH = 8, 100_000, 200_000


def _emails(text: str):
    """An address begins where the run before an @ begins, or behind the last address."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def _ips(text: str):
    """Of a chain of numbers joined by dots, each four in a row."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[i : i + 4]):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of the patterns' matches, by kind and start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    out += [(1, *s) for s in _ips(text)]
    out += [(2, *s) for s in _cards(text)]
    return out + ([(3, *s) for s in _phones(text)] if "+" in text else [])


def entity(kind: int, value: str) -> bytes:
    plain = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
    return hashlib.sha256(f"{KINDS[kind]}:{plain}".encode()).digest()[:16]


def term_of(word: str) -> str:
    return word.strip(PUNCTUATION).lower()


def class_of(term: str) -> str:
    """The generalisation of a term; begins with a space, which no term holds."""
    return f" {term[0]}#{len(term)}" if NUMBER.fullmatch(term) else f" {term[:2]}*"


def _class_column(term):
    return F.when(F.col(term).rlike(f"^{NUMBER.pattern}$"), F.concat(F.lit(" "), F.substring(term, 1, 1), F.lit("#"), F.length(term).cast("string"))).otherwise(
        F.concat(F.lit(" "), F.substring(term, 1, 2), F.lit("*"))
    )


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words outside of the base spans, in order."""
    taken = sorted((s, e) for _, s, e in spans)
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, k = [], 0
    for m in WORD.finditer(text):
        word = m[0].strip(PUNCTUATION)
        if not word:
            continue
        start = m.start() + m[0].index(word)
        end = start + len(word)
        while k < len(merged) and merged[k][1] <= start:
            k += 1
        if k == len(merged) or merged[k][0] >= end:
            out.append((start, end, word.lower()))
    return out


def around(text: str) -> list[tuple[bytes, str, int, int]]:
    """(entity, term or class, hash of the surroundings, 1 for the first in this text).

    A term of "" counts the entity itself; the entity ``ANY`` counts texts with the term near some entity.
    """
    spans = base_spans(text)
    if not spans:
        return []
    words = _terms(text, spans)
    starts = [w[0] for w in words]
    seen, out = set(), []
    for kind, s, e in spans:
        key = entity(kind, text[s:e])
        at = bisect_left(starts, s)
        near = [w[2] for w in words[max(0, at - WINDOW) : at]] + ["\n"] + [w[2] for w in words[at : at + WINDOW]]
        place = int.from_bytes(hashlib.sha256(" ".join(near).encode("utf-8", "surrogatepass")).digest()[:7], "big")
        terms = {t for t in near if t != "\n"}
        for t in {"", *terms, *map(class_of, terms)}:
            if (key, t, place) not in seen:
                out.append((key, t, place, int((key, t) not in seen)))
                seen |= {(key, t), (key, t, place)}
    return out + [(ANY, t, 0, 1) for t in {k[1] for k in seen}]


def joint_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, n, contexts): documents with the term near the entity, and different surroundings."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() if t for r in around(t)]
            for i in range(0, len(rows), FLUSH):
                part = zip(*rows[i : i + FLUSH], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(part, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["entity", "term", "place", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("x")).mapInArrow(tidied(run), "entity binary, term string, place long, n long")
    return rows.groupBy("entity", "term", "place").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))


class _Keys(dict):
    """Word -> its term and class, as far as they are wanted; forgets words beyond a bound."""

    def __init__(self, wanted: frozenset[str] | None, most: int = 200_000):
        self.wanted, self.most = wanted, most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        term = term_of(word)
        keys = (term, class_of(term)) if term else ()
        self[word] = found = keys if self.wanted is None else tuple(k for k in keys if k in self.wanted)
        return found


def document_counts(docs: DataFrame, keys: DataFrame, text: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """(term, n): documents that hold each of ``keys`` (terms and classes) as words outside of base spans."""
    import pyarrow as pa

    few = keys.limit(most_keys + 1).count() <= most_keys
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in keys.collect()) if few else None)

    def run(batches):
        known, counts = _Keys(wanted.value), Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                words = set(WORD.findall(t))
                found = {k for w in words for k in known[w]}
                if found and (spans := base_spans(t)):  # here a word may be part of a span only
                    inside = {w[2] for w in _terms(t, spans)}
                    found &= inside | set(map(class_of, inside))
                counts.update(found)
            if len(counts) >= FLUSH:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    small_batches(docs.sparkSession)
    sums = docs.select(F.col(text).alias("x")).mapInArrow(tidied(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sums if few else sums.join(keys.toDF("term"), "term", "left_semi")


def learn(docs: DataFrame, text: str = "text", disclosed: float = 0.8, contexts: int = 3, most_keys: int = MOST_KEYS) -> DataFrame:
    """Rules (entity, term, kind): what to generalise or remove in documents that hold the entity."""
    at = work_dir(docs.sparkSession, "pii")
    joint = materialize(joint_counts(docs, text), f"{at}/joint")
    total = docs.count()
    alone = joint.where((F.col("term") == "") & (F.col("entity") != F.lit(ANY))).select("entity", (F.log2(F.lit(float(total)) / F.col("n"))).alias("own"))
    share = lambda near, n: F.when(F.col("own") > 0, 1 + F.log2(F.col(near) / F.col(n)) / F.col("own")).otherwise(0.0)
    least = joint.where(F.col("entity") == F.lit(ANY)).select("term", F.col("n").alias("n_least"))  # no term is in fewer documents
    some = joint.where((F.col("contexts") >= contexts) & (F.col("term") != "") & ~F.col("term").startswith(" ") & (F.col("entity") != F.lit(ANY)))
    some = materialize(some.join(alone, "entity").join(least, "term").where(share("n", "n_least") >= disclosed).withColumn("class", _class_column("term")), f"{at}/candidates")
    keys = some.select("term").union(some.select("class")).distinct()
    counted = materialize(document_counts(docs, keys, text, most_keys), f"{at}/counted")
    classes = joint.where("term LIKE ' %'").select("entity", F.col("term").alias("class"), F.col("n").alias("n_class_near"))
    rows = (
        some.join(classes, ["entity", "class"])
        .join(counted.withColumnRenamed("n", "n_term"), "term")
        .join(counted.select(F.col("term").alias("class"), F.col("n").alias("n_class")), "class")
    )
    kind = F.when(share("n_class_near", "n_class") < disclosed, KINDS[4]).otherwise(KINDS[5])
    return materialize(rows.where(share("n", "n_term") >= disclosed).select("entity", "term", kind.alias("kind")), f"{at}/rules")


def spans_of(text: str | None, rules) -> list[tuple[int, int, int]]:
    """All spans of a text; ``rules(entity)`` gives the terms and kinds of an entity."""
    text = text or ""
    found = base_spans(text)
    terms: dict[str, int] = {}
    for key in {entity(k, text[s:e]) for k, s, e in found}:
        for term, kind in rules(key):
            terms[term] = max(terms.get(term, 0), KINDS.index(kind))  # of several entities the stricter rule counts
    return found + sorted((terms[t], s, e) for s, e, t in _terms(text, found) if t in terms) if terms else found


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, rules: DataFrame, text: str = "text", out: str = "spans", drops: tuple[str, ...] = (), most_keys: int = MOST_KEYS) -> DataFrame:
    """Adds ``out``: array of (kind, start, end), by kind and then start."""
    said = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
    if rules.limit(most_keys + 1).count() <= most_keys:
        table: dict[bytes, list] = {}
        for r in rules.collect():
            table.setdefault(bytes(r.entity), []).append((r.term, r.kind))
        held = docs.sparkSession.sparkContext.broadcast(table)

        def make():
            known = held.value
            return lambda texts: [[said(spans_of(t, lambda key: known.get(key, ()))) for t in texts]]

        return add_columns(docs, make, f"{out} {SPANS}", [text], drops)

    rows, row = with_row(docs)
    own = free_name(rows, "_rules")
    keys = add_columns(rows.select(F.col(row).alias("r"), F.col(text).alias("x")), lambda: lambda xs: [[list({entity(k, x[s:e]) for k, s, e in base_spans(x)}) if x else [] for x in xs]], "keys array<binary>", ["x"], ("x",))
    by_row = keys.select("r", F.explode("keys").alias("entity")).join(rules, "entity").groupBy("r").agg(F.collect_list(F.struct("entity", "term", "kind")).alias(own)).withColumnRenamed("r", row)

    def make_joined():
        def one(t, given):
            table = {}
            for g in given or ():
                table.setdefault(bytes(g["entity"]), []).append((g["term"], g["kind"]))
            return said(spans_of(t, lambda key: table.get(key, ())))

        return lambda texts, given: [[one(*x) for x in zip(texts, given, strict=True)]]

    return add_columns(rows.join(by_row, row, "left"), make_joined, f"{out} {SPANS}", [text, own], (*drops, row, own))


def sanitise(docs: DataFrame, rules: DataFrame, text: str = "text", **options) -> DataFrame:
    """``text`` with personal data as marks, generalised terms as their class and sensitive terms left out."""
    spans = free_name(docs, "_spans")

    def shown(kind: str, value: str) -> str:
        if kind == KINDS[5]:
            return ""
        return f"[{kind.upper()}]" if kind != KINDS[4] else value[0] + "x" * (len(value) - 1) if NUMBER.fullmatch(value) else value[:2] + "…"

    def clean(t, found):
        parts, at = [], 0
        for s in sorted(found or (), key=lambda s: (s["start"], s["end"])):
            if s["start"] >= at:
                parts += [t[at : s["start"]], shown(s["kind"], t[s["start"] : s["end"]])]
            at = max(at, s["end"])
        return "".join([*parts, t[at:]]) if parts else t

    marked = find(docs, rules, text, spans, **options)
    return add_columns(marked, lambda: lambda texts, found: [[clean(*x) for x in zip(texts, found, strict=True)]], f"{text} string", [text, spans], (spans,)).select(*(f"`{c}`" for c in docs.columns))


def digest(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the base kinds and the joined spans."""
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col(spans)).alias("spans"))

