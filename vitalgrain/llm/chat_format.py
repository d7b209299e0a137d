"""Chat formatting with Spark expressions only.

Template, per block of adjacent turns of one role::

    [INST]role[/INST]text<sep>text</s>

Control strings inside roles and texts are escaped reversibly: every backslash is doubled and a
backslash is put behind the first character of each control string. Escaped text therefore never
holds a control string, and none can arise where text meets a mark.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role or text counts as
empty; rows of a null conversation id form one conversation; repeated rows stay repeated turns;
an empty table gives no rows; further columns are ignored, whatever their names.
One conversation becomes one string, so it has to fit in a row (2 GB); that is the output's own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks.
OPEN, CLOSE, SEP, END = "[INST]", "[/INST]", "<sep>", "</s>"
CONTROL = r"(<)(/?s>|sep>)|(\[)(/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive)."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select(
        "conv_id", "role", F.row_number().over(order).alias("n"), escape(F.col("text")).alias("body"),
        (~F.lag("role").over(order).eqNullSafe(F.col("role"))).alias("opens"), (~F.lead("role").over(order).eqNullSafe(F.col("role"))).alias("ends"),
    )
    # each turn brings its block's head or a separator, its text, and its block's end
    head = F.when(F.col("opens"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))).otherwise(SEP)
    pieces = placed.select("conv_id", "n", (F.col("role") == LOSS_ROLE).alias("loss"), F.length("body").alias("size"), F.length(head).alias("before"), F.concat(head, "body", F.when(F.col("ends"), END).otherwise("")).alias("piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    start = (upto - F.length("piece") + F.col("before")).cast("int")
    spans = pieces.select("conv_id", F.struct("n", "piece", "loss", start.alias("start"), (start + F.col("size")).alias("end")).alias("p"))
    grouped = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Parse formatted strings back: adds turns (role, text) and loss_text, both unescaped."""
    bodies = formatted.withColumn("_parts", F.split("formatted", END)).withColumn("_parts", F.slice("_parts", 1, F.size("_parts") - 1))
    split = bodies.withColumn(
        "_blocks",
        F.transform(
            "_parts",
            lambda p: F.struct(
                F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), CLOSE, 1).alias("role"),
                F.split(F.substr(p, F.instr(p, CLOSE) + len(CLOSE)), SEP).alias("texts"),
            ),
        ),
    )
    return split.withColumn(
        "turns",
        F.flatten(
            F.transform(
                "_blocks",
                lambda b: F.transform(b["texts"], lambda x: F.struct(unescape(b["role"]).alias("role"), unescape(x).alias("text"))),
            )
        ),
    ).withColumn(
        "loss_text",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), ""
        ),
    ).drop("_parts", "_blocks")


def digest_chat(read: DataFrame) -> DataFrame:
    """The digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
