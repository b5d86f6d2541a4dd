"""Laws of the two-pass shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from nearpass.llm import sharding

SF = "/root/testdata/sf0.001"


def frame(spark):
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(None, "same")] * 100 + [(None, None)] * 5 + [(7, "again")] * 50 + [(8, ""), (9, None), (10, "é" * 5000)]
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, slot int, _bucket string")


def test_every_row_has_one_place(spark):
    df = frame(spark)
    got = sharding.shards(df, 8, bucket_bytes=64).collect()
    assert Counter((r["doc_id"], r["text"], r["_bucket"]) for r in got) == Counter((r["doc_id"], r["text"], r["_bucket"]) for r in df.collect())
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_the_order_depends_on_the_seed_alone(spark):
    df = frame(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    place = lambda d, **how: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shards(d, 5, **how).select("doc_id", "shard", "slot").collect()}
    one = place(df)
    assert one == place(df.repartition(7)) and one != place(df, seed=2)


def test_copies_without_id_spread_over_buckets(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = [r["count"] for r in sharding.scatter(df, "text", "doc_id", 1, 1 << 24, "b").groupBy("b").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 40


def test_written_shards_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert sharding.shards(docs.limit(0), 4).count() == 0
