import hashlib

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from vitalgrain.llm import bpe  # noqa: E402

PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
TEXTS = [None, "", " ", "a  b\t\n c", "the the them", "naïve Straße 漢字 𝄞 don't 12345 !!??", "x" * 300, "   y", "zq" * 40 + " \n"]


def test_matches_the_library_and_round_trips(spark, tmp_path):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string")
    df.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    twice = spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs")
    for docs, coded in ((df, None), (read, None), (read, "decoded"), (twice, "decoded")):
        rows = bpe.encode(docs, PATH, PATTERN, decoded=coded, chunk_words=2)
        rows = (rows if coded else bpe.decode(rows, PATH)).collect()
        assert len(rows) == len(TEXTS) * (2 if docs is twice else 1)
        for r in rows:
            text = TEXTS[r.doc_id] or ""
            want = own.encode_ordinary(text)
            assert r.ids == want and bytes(r.decoded) == text.encode() and r.words == "kept"
            assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()


def test_every_token_is_reached_by_merges(spark):
    ranks = bpe.load_ranks(PATH)
    tokens = [(t.decode(), r) for t, r in ranks.items() if len(t) > 1 and t.decode("utf-8", "ignore").encode() == t][::97]
    tok = bpe.Tokenizer(spark, PATH, bpe.work_dir(spark, "test"))
    out = tok.folded(spark.createDataFrame(tokens, "w string, r int").select("r", F.array("w").alias("w")), "w").collect()
    assert all(x.ids == [[x.r]] for x in out)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH, PATTERN).count() == 0
