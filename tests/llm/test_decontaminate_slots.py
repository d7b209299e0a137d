"""Slots of templates over whole passages."""

import random
import re

import pytest

from vitalgrain.llm import decontaminate

Q = "If Tom runs 10 km in 50 minutes, how far does Tom run in 20 minutes?"
CASES = {
    "If Sue runs 12 km in 40 minutes, how far does Sue run in 30 minutes?": True,
    "If Sue runs 12 km in 40 minutes, how far does Bob run in 30 minutes?": False,
    "If Mary Jane runs 12 miles in 40 minutes, how far does Mary Jane run in 30 minutes?": True,
    "If Mary Jane runs 12 miles in 40 minutes, how far does Mary Ann run in 30 minutes?": False,
    "If Sue runs 12 km in 40 minutes, how far does Sue run in 40 minutes?": False,  # 50 and 20 became one number
    "So: If Tom runs 10 km in 50 minutes, how far does Tom run in 20 minutes? And on.": True,
    "if tom runs 10 km in 50 minutes, how far does tom run in 20 minutes?": True,
}


def found(spark, items, texts):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in decontaminate.contaminated(decontaminate.find(docs, items)).collect()}


def test_slots_agree_over_the_passage(spark):
    got = found(spark, [Q], CASES)
    assert {t: (i, 0) in got for i, t in enumerate(CASES)} == CASES


def test_two_passages_of_one_text_are_looked_at_apart(spark):
    ok, bad = list(CASES)[0], list(CASES)[1]
    got = found(spark, [Q], [f"{bad} Then: {ok}", f"{ok} Then: {ok.replace('Sue', 'Ann')}", f"{bad} Then: {bad}"])
    assert set(got) == {(0, 0), (1, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_substitutions(spark, seed):
    rng = random.Random(seed)
    words = "the train goes from home to work and then back again with all its load over many hills each day".split()
    names, items, texts, want = ["Tom", "Ann", "Boris", "Clara", "Doris"], [], [], {}
    for n in range(12):
        own = rng.sample(names, 2)
        said = [rng.choice(words) for _ in range(40)]
        for at in range(3, 40, 6):
            said[at] = rng.choice([*own, str(rng.randrange(10, 99))])
        said[1] = f"w{chr(97 + n)}x"
        slots = sorted({w for w in said if w in names or w.isdigit()})
        items.append(" ".join(said))
        new = dict(zip(slots, [f"Zed{chr(97 + i)}" if s in names else str(1000 + i) for i, s in enumerate(slots)], strict=True))
        again = [new.get(w, w) for w in said]
        torn = list(again)
        spots = [i for i, w in enumerate(said) if w in slots and said.count(w) > 1]
        want[len(texts), n] = True
        texts.append("so " + " ".join(again))
        if spots:
            torn[spots[-1]] = "Yolo" if said[spots[-1]] in names else "7777"
            want[len(texts), n] = False
            texts.append("so " + " ".join(torn))
    got = found(spark, items, texts)
    for (doc, item), fits in want.items():
        if fits:
            assert got[doc, item][0] >= got[doc, item][1] - 2  # the opening word may be a name here and none there
        else:
            assert (doc, item) not in got or got[doc, item][0] <= plain_windows(items[item], texts[doc])


def plain_windows(a, b):
    """Runs of ten words of one text that stand in the other."""
    split = lambda t: re.findall(r"\S+", t.lower())
    runs = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    return len(runs(split(a)) & runs(split(b)))
