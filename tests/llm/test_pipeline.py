"""Each stage on its own input, with nulls, repeated rows and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gevel.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7000, "", "en", "s", 0), (7001, None, "en", None, 0), (None, "12 34", "en", "s", 5)], rows.schema)
    twice = rows.where("doc_id in (1, 2)")
    return rows.unionByName(odd).unionByName(twice).withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "id": F.lit(None).cast("long"), "n": F.lit(2)}).cache()


@pytest.mark.parametrize("k", range(4))
def test_columns_stay(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    assert out.where("score != 1 or lang_pred != 'x' or n != 2").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, docs.where("doc_id = -1"), SF).count() == 0


def test_language_keeps_texts_with_letters(spark, docs):
    kept = corpus_pipeline.by_language(spark, docs, SF)
    assert kept.where("doc_id < 7000").count() == docs.where("doc_id < 7000").count()
    assert kept.where("text is null or text in ('', '12 34')").count() == 0
    odd = [(8000, "qzx jkwv bqpt xzzk wqjv kkzq pvxw zqj " * 6), (8001, "съешь ещё этих мягких французских булок да выпей чаю"), (8002, "zażółć gęślą jaźń pchnąć w tę łódź jeża lub ośm skrzyń fig")]
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.lang: r.text for r in more.where("length(text) > 600").collect()}
    clean = [(8003, " ".join(" ".join(t.split()[:25]) for t in texts.values()))]
    more = more.where("doc_id not between 8000 and 8999").unionByName(spark.createDataFrame(odd + clean, "doc_id long, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.by_language(spark, more, SF)
    assert [r.doc_id for r in kept.where("doc_id between 8000 and 8999").collect()] == [8003] and kept.count() == more.count() - 3


def test_toxicity_keeps_clean_texts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.by_toxicity(spark, docs, SF).join(labels.where("toxic = 0"), "doc_id").select("doc_id").distinct().count()
    assert kept >= 0.97 * labels.where("toxic = 0").join(docs, "doc_id").select("doc_id").distinct().count()


def test_toxic_texts_go(spark, docs):
    toxic = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 1")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.by_toxicity(spark, rows, "/root/testdata/sf0.01")
    assert kept.join(toxic, "doc_id").count() <= 0.2 * rows.join(toxic, "doc_id").count() and kept.count() >= 0.8 * rows.count()


def test_repeated_ids_are_documents_of_their_own(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, "another text with the same id that is quite different"), (2, " ".join(words)), (2, " ".join(words)), (3, ""), (3, None), (None, " ".join(words))]
    kept = corpus_pipeline.by_nearness(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [type(kept[0])(doc_id=k, text=t) for k, t in (rows[0], rows[1], rows[4], rows[5], rows[6])]))


def test_one_of_each_group_stays(spark, docs):
    from test_operators import groups

    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    want = sorted(k for k, (_, c) in groups(texts, 5, 80).items() if k == c)
    kept = corpus_pipeline.by_nearness(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 2


def test_texts_without_personal_data(spark, docs):
    out = corpus_pipeline.without_pii(spark, docs, SF)
    before = {r.doc_id: r.text for r in docs.where("doc_id < 7000").collect()}
    for r in out.where("doc_id < 7000").collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not any(pii.spans(before[r.doc_id])[1].values()))
    assert out.where("text is null").count() == 2


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
