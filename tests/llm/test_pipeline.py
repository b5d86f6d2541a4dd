"""Each pipeline stage against brute force on its own input."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nearpass.llm import langid
from nearpass.llm.common import stored
from tests.llm.test_mixing import check
from tests.llm.test_nearcopies import direct as copies
from tests.llm.test_repetition import direct

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What every stage gets, and the last one's result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SF), name)
    return [*out, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_in_order(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mixing", "bpe"]
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert all(a.count() > b.count() for a, b in zip(tables[1:4], tables[2:5]))


def test_language(spark, tables):
    net = langid.train(langid.learnable(tables[0]))
    judged = langid.identify(tables[0], net)
    assert ids(judged.filter("lang_pred <> 'und' and score >= 0.4")) == ids(tables[1])
    assert tables[1].count() >= 0.98 * tables[0].count()


def test_quality(tables):
    kept = []
    for r in tables[1].collect():
        m = direct(r["text"] or "") if len((r["text"] or "").split()) < 500 else None
        if m is None:
            continue
        n = m["n_words"]
        if n >= 20 and 100 * m["n_repeat_words"] <= 30 * n and m["covered_words"] <= 0.35 * n and m["longest_repeat"] <= 100:
            kept.append(r["doc_id"])
    assert sorted(kept) == [r["doc_id"] for r in tables[2].orderBy("doc_id").collect() if len((r["text"] or "").split()) < 500]


def test_near_duplicates(tables):
    rows = [(r["doc_id"], r["text"]) for r in tables[2].collect()]
    assert ids(tables[3]) == sorted({c for _, c in copies(rows)})


def test_mixing(spark, tables):
    from nearpass.llm import mixing

    got = check(mixing.mix(tables[3]))
    assert sorted(r["doc_id"] for r in got if r["sampled"]) == ids(tables[4])


def test_encoding(tables):
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    tok.no_truncation()
    text = {r["doc_id"]: r["text"] for r in tables[4].collect()}
    got = tables[5].collect()
    assert len(got) == len(text) > 0
    assert all(r["ids"] == tok.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_gives_the_rows_of_the_stages(spark, tables):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(tables[5])
    null = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], tables[0].schema)
    docs = null
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.agg(F.count("*")).first()[0] == 0
