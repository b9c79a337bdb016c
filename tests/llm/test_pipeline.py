"""The pipeline: each stage against what it should keep, and the queries' registration."""

import pytest

import __spark_entry__
import corpus_pipeline
from factloom.llm import language, minhash, quality, registry

SF = "/root/testdata/sf0.01"


def test_registered():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(names) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage, as the runner hands them on."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, steps):
    assert [n for n, _, _ in steps] == ["quality", "language", "lines", "near_duplicates", "packing"]
    rows = {n: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for n, a, b in steps[:4]}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, before, after in steps[:4]:
        assert after.dtypes == before.dtypes and after.columns == corpus_pipeline.COLUMNS, name
        assert rows[name][1].keys() <= rows[name][0].keys()
    good = {r.doc_id for r in quality.score(steps[0][1], labels).collect() if r.predicted}
    assert rows["quality"][1].keys() == good
    rejected = {r.doc_id for r in language.identify(steps[1][1]).collect() if r.rejected}
    assert rows["language"][1].keys() == rows["language"][0].keys() - rejected
    for k, r in rows["lines"][1].items():
        old = rows["lines"][0][k]
        assert set(r.text.split("\n")) <= set(old.text.split("\n")) and r.n_chars == len(r.text)
    copies = {r.doc_id for r in minhash.near_duplicates(steps[3][1], 5, 80).collect() if not r.kept}
    assert rows["near_duplicates"][1].keys() == rows["near_duplicates"][0].keys() - copies
    packed = steps[4][2]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == rows["near_duplicates"][1].keys()


def test_run_and_empty(spark, steps, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1][2].count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_copies_stay_once(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 1), (2, base + " more", "en", "s", 1), (3, base, "en", "s", 1), (4, "other text", "en", "s", 1), (None, base, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or -1) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [-1, 1, 4]


def test_repeated_ids_are_documents_of_their_own(spark):
    base, unlike = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(7, base + " more", "en", "s", 1), (1, base, "en", "s", 1), (7, unlike, "en", "s", 1), (9, unlike, "en", "s", 1), (9, unlike, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, base), (7, unlike)]
