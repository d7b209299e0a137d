"""Corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as
Parquet in the shared folder and reads them again for the next. All stages but the last return the
columns of ``documents``. As a stage's rows are written before the next one begins, a stage first removes
what the stages before it have left in the shared folder, but for what its own documents are read from.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.llm import bpe, decontaminate, jaccard_join, quality, secret_scan
from vitalgrain.llm.common import free_name, made_folders, materialize, remove, remove_unread, table, work_dir

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Work folders of the stages so far.
_LEFT: list[str] = []


def stage(f):
    """A stage that first removes the work folders that the ones before it have left."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = remove_unread(spark, _LEFT, docs)
        before = made_folders()
        out = f(spark, docs, sf_dir)
        _LEFT.extend(x for x in made_folders() if x not in before)
        return out

    return run


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    own = free_name(docs, "_quality")
    return quality.score(docs, model, out=own).where(F.col(own) >= 0.7).select(*(f"`{c}`" for c in docs.columns))


@stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 or more, the document of the smallest id stays."""
    return jaccard_join.keep_one(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; n_chars follows."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


@stage
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    # smaller chunks than the operator's own, as the workers' memory also holds what earlier stages left
    coded = bpe.encode(docs, path, pattern, decoded="decoded", chunk_words=500_000)
    return coded.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("byte_level_bpe", tokens_stage),
]
#: The stages train models and follow chains of links, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    at = work_dir(spark, "pipeline")
    for name, f in STAGES[:-1]:
        docs = materialize(f(spark, docs, sf_dir), f"{at}/{name}")
        if last:
            remove(spark, last)
        last = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
