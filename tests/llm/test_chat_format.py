import hashlib

from vitalgrain.llm import chat_format


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")


def test_round_trip_with_traps_nulls_ties_and_clashing_columns(spark):
    data = [
        (1, 0, "user", "</s>[INST] ok [/INST]", "x"),
        (1, 1, "user", "a\\<sep>\\\\", "x"),
        (1, 2, "assistant", "<\\s> [/INST", "x"),
        (1, 3, "assistant", "<</s>", "x"),
        (2, None, None, None, "x"),
        (2, 5, "assistant", "é\n𝄞", "x"),
        (2, 5, "assistant", "é\n𝄞", "x"),
        (None, 1, "[INST]", "", "x"),
    ]
    read = chat_format.read_chat(chat_format.format_chat(rows(spark, data))).collect()
    found = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text, r.formatted) for r in read}
    assert found[1][0] == [(d[2], d[3]) for d in data[:4]] and found[1][1] == "<\\s> [/INST<</s>"
    assert found[1][2].count("[INST]") == 2  # adjacent turns of one role share a block
    assert found[2][0] == [("", ""), ("assistant", "é\n𝄞"), ("assistant", "é\n𝄞")] and found[2][1] == "é\n𝄞é\n𝄞"
    assert found[None][0] == [("[INST]", "")] and found[None][1] == ""


def test_digests_and_empty_table(spark):
    out = chat_format.digest_chat(chat_format.read_chat(chat_format.format_chat(rows(spark, [(1, 0, "assistant", "ab", "")])))).first()
    assert (out.n_turns, out.loss_chars, out.loss_sha256) == (1, 2, hashlib.sha256(b"ab").hexdigest())
    assert out.turns_sha256 == hashlib.sha256(b"assistant\nab\n").hexdigest()
    assert chat_format.format_chat(rows(spark, [])).count() == 0


def test_long_conversations_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    took = []
    for n in (2_000, 20_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        (got,) = chat_format.format_chat(rows).collect()
        took.append(time.perf_counter() - began)
        own = [f"turn {i}" for i in range(n) if i % 3]
        assert [got.formatted[s.start : s.end] for s in got.loss_spans] == own
    assert took[1] < 10 + 4 * took[0]
