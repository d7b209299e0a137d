"""Personal data: patterns, co-occurrence rules and marked texts against brute force."""

import hashlib
import math
import random
import re
import time

import pytest

from vitalgrain.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def brute_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and not (16 <= len(digits) <= 19 and luhn(digits))) or (k == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append((k, *m.span()))
    return out


def test_spans_match_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "b@", "@", "c.d", ".", "1", "23", "255", "300", "4111111111111111", " ", "-", "+", "(", "%", ")", "_", "é", "\n", "0"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text", ["9" * 300_000, "9." * 150_000, "a@" * 150_000, "a" * 300_000 + "@", "+1" * 150_000, "+1" + " " * 300_000, "9 " * 150_000, "1.2.3." * 50_000 + "4"])
def test_long_texts_take_no_quadratic_time(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 5


def brute_rules(texts, disclosed=0.8, contexts=3):
    """Rules from plain counts over whole texts."""
    near, places, holds, entities = {}, {}, {}, {}
    for text in texts:
        text = text or ""
        spans = brute_spans(text)
        words = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            plain = m[0].strip(pii.PUNCTUATION)
            at = m.start() + m[0].find(plain)
            if plain and not any(s < at + len(plain) and at < e for _, s, e in spans):
                words.append((at, plain.lower()))
        for t in {w for _, w in words} | {pii.class_of(w) for _, w in words}:
            holds[t] = holds.get(t, 0) + 1
        seen = set()
        for k, s, e in spans:
            key = pii.entity(k, text[s:e])
            before, after = [w for at, w in words if at < s][-8:], [w for at, w in words if at >= s][:8]
            seen.add((key, None))
            for t in set(before + after) | {pii.class_of(w) for w in before + after}:
                seen.add((key, t))
                places.setdefault((key, t), set()).add((tuple(before), tuple(after)))
        for key, t in seen:
            if t is None:
                entities[key] = entities.get(key, 0) + 1
            else:
                near[key, t] = near.get((key, t), 0) + 1

    def share(key, t):
        own = math.log2(len(texts) / entities[key])
        return 1 + math.log2(near[key, t] / holds[t]) / own if own > 0 else 0.0

    return {
        (key, t, "general" if share(key, pii.class_of(t)) < disclosed else "removed")
        for key, t in near
        if not t.startswith(" ") and len(places[key, t]) >= contexts and share(key, t) >= disclosed
    }


def people(seed, n=120):
    rng = random.Random(seed)
    words = "the of and report meeting about office letter old new green 17 2024 43,5 paper said went".split()
    persons = [("Zorblatt", "zorblatt@corp.example"), ("Quimby", "+1 555 123 4567"), ("Vexler", "10.0.0.7"), ("44657", "4111 1111 1111 1111")]
    texts = []
    for _ in range(n):
        said = [rng.choice(words) for _ in range(rng.randrange(3, 30))]
        if rng.random() < 0.2:
            name, data = rng.choice(persons)
            at = rng.randrange(len(said))
            said[at:at] = [f"({name}),", rng.choice(words), data]
            if rng.random() < 0.3:
                said.append(name.upper() + "!")
        texts.append(" ".join(said))
    return texts + ["", None, texts[0], texts[1]]


@pytest.mark.parametrize("most_keys", [100_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_rules_and_spans_match_brute_force(spark, seed, most_keys):
    texts = people(seed)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rules = pii.learn(docs, most_keys=most_keys)
    want = brute_rules(texts)
    assert {(bytes(r.entity), r.term, r.kind) for r in rules.collect()} == want
    assert {"zorblatt", "quimby"} <= {t for _, t, _ in want} and not {"the", "report"} & {t for _, t, _ in want}
    found = pii.find(docs.selectExpr("*", "1 AS n_email", "2 AS _row", "3 AS _rules"), rules, most_keys=most_keys).collect()
    assert len(found) == len(texts)
    for r in found:
        text = r.text or ""
        base = brute_spans(text)
        got = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans]
        assert got[: len(base)] == base and sorted(got) == got
        own = {pii.entity(k, text[s:e]) for k, s, e in base}
        mine = {t: max(kind for k2, t2, kind in want if t2 == t and k2 in own) for k, t, _ in want if k in own}
        added = [(text[s:e].lower(), pii.KINDS[k]) for k, s, e in got[len(base) :]]
        assert set(added) == {(t, k) for t, k in mine.items() if re.search(rf"(?i)(?<![\w])({re.escape(t)})(?![\w])", text)}


def test_texts_are_sanitised(spark):
    texts = people(3)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rules = pii.learn(docs)
    done = {r.doc_id: r for r in pii.sanitise(docs, rules).collect()}
    assert len(done) == len(texts) and all(r.spans == 7 for r in done.values())
    for i, t in enumerate(texts):
        if t and brute_spans(t):
            assert not brute_spans(done[i].text) and "zorblatt" not in done[i].text.lower()
        else:
            assert done[i].text == t


def test_copies_are_no_evidence(spark):
    text = "write to Zorblatt at zorblatt@corp.example today"
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(i, "nothing here") for i in range(20, 90)], "doc_id long, text string")
    assert pii.learn(docs).count() == 0
    (one,) = pii.digest(pii.find(docs.where("doc_id = 3"), pii.learn(docs))).collect()
    start = text.index("zorblatt@")
    said = f"email:{start}:{start + 21}"
    assert one.spans == said and one.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and one.n_email == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rules = pii.learn(docs)
    assert rules.count() == 0 and pii.digest(pii.find(docs, rules)).count() == 0
