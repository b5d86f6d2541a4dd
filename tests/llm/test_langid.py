"""Language identification: held-out accuracy and odd rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearpass.llm import langid, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return langid.train(langid.learnable(spark.read.parquet(f"{SF}/documents.parquet")))


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_id"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 1000
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = got.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert r["n"] > 200 and r["ok"] > 0.98
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows(spark, net):
    rows = [(1, None), (2, ""), (3, "12 34 !? \n"), (4, "漢字"), (5, "the and of was " * 40), (5, "the and of was " * 40), (None, "é"), (7, "the and of " * 200000)]
    df = spark.createDataFrame([(*r, "old", 2.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df, net).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False, False, False]
    assert all(r["score"] == 0.0 for r in got[:3]) and got[4] == got[5] and got[4]["lang_pred"] == got[6]["lang_pred"] == "en"
    kept = langid.keep_identified(df, net)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {5, 7} and kept.filter("doc_id < 4").count() == 0
    assert langid.identify(df.limit(0), net).count() == 0


def test_without_labels_all_is_unknown(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "..", "en")], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"} and langid.keep_identified(df, None).count() == 0


def test_windows_do_not_depend_on_batches(net):
    texts = ["the and " * 300, "der die und", None, "le la et " * 900, "x"]
    one = langid._predict(net, pa.array(texts))
    parts = [langid._predict(net, pa.array([t], pa.string())) for t in texts]
    assert one[0] == [p[0][0] for p in parts] and one[1] == pytest.approx([p[1][0] for p in parts], abs=1e-6)
