"""The pipeline's stages on a small table, and that nothing else imports the subpackage."""

import ast
import pathlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

ROOT = pathlib.Path(__file__).resolve().parents[2]
SF = pathlib.Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(SF)), f"{corpus_pipeline.work_dir(spark, 'test')}/{name}")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == before and all(r.text == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in out)


PROSE = "the small river runs past an old mill and a quiet garden where two friends often walk in spring".split()
EXTRA = ["_row", "_quality", "ids", "decoded", "row", "label", "n_tokens", "odd name"]


def write_tables(spark, at, rows):
    """documents (with columns whose names the stages use themselves), labels and benchmark below ``at``."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), *EXTRA) for i, t in rows], schema)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "Which of the nine blue boats reached the far harbour first that evening"), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def stages(spark, at, docs):
    """The rows after each stage, each written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/after/{name}")
        docs = spark.read.parquet(f"{at}/after/{name}")
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names clash."""
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(PROSE) for _ in range(n)) + "."
    junk = lambda: " ".join(rng.choice("$%&*#!") * 3 + rng.choice(PROSE).upper() for _ in range(60))
    rows = [(i, prose(80) if i % 2 else junk()) for i in range(200)]
    item = "Which of the nine blue boats reached the far harbour first that evening"
    base, long, secret = prose(90), " ".join(prose(40) + "\n" for _ in range(500)), prose(40) + " token = abcdef1234567890 " + prose(40)
    rows += [(None, base), (None, base), (300, base), (301, None), (302, ""), (303, long), (303, long), (304, secret), (305, prose(50) + " " + item + ". " + prose(50)), (None, item + " " + prose(60)), (307, prose(70)), (307, prose(70))]
    at = f"{tmp_path}"
    docs = write_tables(spark, at, rows)
    quality_, near, clean, secrets, tokens = stages(spark, at, docs)
    for df in (quality_, near, clean, secrets):
        assert df.columns == docs.columns
        assert all(r[c] == c for r in df.collect() for c in EXTRA)
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    first = listed(quality_)
    assert not any(i is not None and i < 200 and i % 2 == 0 for i, _ in first) and sum(t == base for _, t in first) == 3 and sum(t == long for _, t in first) == 2
    second = listed(near)
    assert [i for i, t in second if t == base] == [300] and [i for i, t in second if t == long] == [303] and sum(i == 307 for i, _ in second) == 2
    third = listed(clean)
    assert sorted(second, key=str) == sorted(third + [x for x in second if x[1] and item in x[1]], key=str) and len(second) == len(third) + 2
    texts = dict(listed(secrets))
    assert "abcdef1234567890" not in texts[304] and "[SECRET]" in texts[304] and {t for i, t in third if i != 304} == {t for i, t in listed(secrets) if i != 304}
    assert all(r.n_chars == len(r.text) for r in secrets.collect() if r.text is not None)
    out = tokens.collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((i, t or "") for i, t in listed(secrets)), key=str) and all(r.n_tokens == len(r.ids) for r in out)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = write_tables(spark, f"{tmp_path}", [])
    for df in stages(spark, f"{tmp_path}", docs):
        assert df.count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as N

    from vitalgrain.llm import common

    made = lambda master, found: N(conf=N(get=lambda *_: found), sparkContext=N(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(made(master, None))
        assert common.shared_dir(made(master, "hdfs://shared/")) == "hdfs://shared"
    assert common.shared_dir(made("local[4]", None)).startswith("file:///tmp/checkpoints/")


def test_copies_of_one_row_cannot_enlarge_a_sample(spark):
    from vitalgrain.llm.common import hash_sample

    df = spark.range(2000).selectExpr("id", "'x' AS t").union(spark.range(3000).selectExpr("cast(null as long) AS id", "'copy' AS t"))
    assert hash_sample(df, ["id", "t"], 500).count() < 500 and hash_sample(df, ["id", "t"], 5000).count() == 5000


def test_only_the_entry_and_the_pipeline_import_it():
    for path in (ROOT / "vitalgrain").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
