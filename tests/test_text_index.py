"""Searches by trigrams against scans, and what they read."""

import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from vitalgrain.functions import filters
from vitalgrain.operators import text_index

TERMS = ["the", "THE CAT", "a.b", "é à", "st", "", "xyzzy", "İst", "100%", "σας", "5µm"]
PATTERNS = ["the c.t", "ca[rt]s?", "(the|a) cat", "colou?r", r"\d\d\d%", "i?st", "straße", "cat.*dog", "ab{2}c", "ist", r"a\.b", "µm"]


def texts():
    rng = random.Random(3)
    words = ["the", "cat", "Cats", "car", "dog", "DOG", "a.b", "aXb", "É À", "é à", "Straße", "STRASSE", "İstanbul", "ıst", "ſt", "colour", "color", "100%", "abbc", "ΣΑΣ", "σας", "5µm", "5μm", "x"]
    return [None, "", "ab"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(150)]


def test_searches_equal_scans(spark, tmp_path):
    rows = [(i * 40_000 if i % 10 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    text_index.build(df, "id", "text", f"{tmp_path}/i", 8)
    got = lambda found: sorted(map(str, (tuple(r) for r in found.collect())))
    for term in TERMS:
        assert got(text_index.search(df, "id", "text", f"{tmp_path}/i", term, shards=8)) == got(df.where(filters.contains_literal(["text"], term))), term
    for pattern in PATTERNS:
        assert got(text_index.search(df, "id", "text", f"{tmp_path}/i", pattern, False, 8)) == got(df.where(filters.contains("text", pattern))), pattern


def test_a_search_reads_its_trigrams_folders(spark, tmp_path):
    df = spark.range(300).select("id", F.concat(F.lit("row number "), F.col("id").cast("string")).alias("text"))
    text_index.build(df, "id", "text", f"{tmp_path}/i", 64)
    some = text_index.candidates(df, "id", f"{tmp_path}/i", text_index.grams_of(["r 299"]), 64)
    assert [r.id for r in some.collect()] == [299]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({f for f in some.inputFiles()}) <= 64
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    assert "shard" in scan.split("PartitionFilters")[1] and "gram" in scan.split("PushedFilters")[1]


def test_literals_of_patterns():
    assert text_index.literals("the c.t") == ["the c", "t"] and text_index.literals("a|b") == [] and text_index.literals(r"\d+abc") == ["abc"]
    assert text_index.literals("colou?r") == ["colo", "r"] and text_index.literals(r"a\.bcd") == ["a.bcd"] and text_index.literals("x(yz)*w") == ["x", "w"]


def by_hand(rows):
    want = defaultdict(set)
    for i, t in rows:
        for k in range(len(t) - 2):
            want[t[k : k + 3], i // text_index.BLOCK].add(i % text_index.BLOCK)
    return want


def test_postings_are_a_row_per_trigram_and_block_of_a_stretch():
    """Texts meet in a stretch, whatever their number; they may be cut anywhere, and neighbours have no trigram in common."""
    rng = random.Random(4)
    rows = [(rng.randrange(-200_000, 200_000), "".join(rng.choice("abcé😀\0") for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    rows += [(i, t[::-1]) for i, t in rows[:20]]  # an id twice
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t.encode() for _, t in part], pa.binary())], ["id", "text"]) for part in (rows[:100], rows[100:])]
    want = by_hand(rows)
    for most in (1 << 22, 500, 7):
        got, n = defaultdict(set), 0
        for batch in text_index.postings(iter(batches), most):
            for r in batch.to_pylist():
                assert r["ids"] == sorted(set(r["ids"]))
                got[r["gram"], r["block"]] |= set(r["ids"])
                n += 1
        assert got == want and (most < 1 << 22 or n == len(want))
    wide = [(1, "".join(map(chr, range(0x100, 0xD000)))), (2, "".join(map(chr, range(0xE000, 0x10000)))), (3, "abc")]  # too many letters for one stretch of many texts
    many = wide + [(10 + i, "abc") for i in range(70_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in many]), pa.array([t.encode() for _, t in many], pa.binary())], ["id", "text"])
    got = defaultdict(set)
    for made in text_index.postings(iter([batch])):
        for gram, block, ids in zip(*(made[c].to_pylist() for c in ("gram", "block", "ids")), strict=True):
            got[gram, block] |= set(ids)
    assert got == by_hand(many)


def test_an_index_holds_each_id_once_per_trigram(spark, tmp_path):
    rows = [(i * 1000, "the cat" if i % 2 else "catalogue") for i in range(200)] + [(5, None), (6, ""), (7, "ab"), (0, "the cat")]
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    text_index.build(spark.read.parquet(f"{tmp_path}/t"), "id", "text", f"{tmp_path}/i", 8)
    got = {(r.gram, r.block): r.ids for r in spark.read.parquet(f"{tmp_path}/i").collect()}
    assert got == {k: sorted(v) for k, v in by_hand([(i, t or "") for i, t in rows]).items()}
