"""Encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from nearpass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_splitters_agree():
    exact, split = ByteLevel(add_prefix_space=False).pre_tokenize_str, bpe.Splitter([])
    every = list(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for cut, chars in ((split.settled, [c for c in every if not split.unsettled(c)]), (split.latin, [c for c in every if not split.beyond_latin(c)])):
        assert len(chars) > 500
        for i in range(0, len(chars), 64):
            s = " x".join(f"{c}{c} {c}1{c} '{c}'s" for c in chars[i:i + 64])
            assert [s[a:b] for _, (a, b) in exact(s)] == cut(s)


def texts():
    rng = random.Random(1)
    parts = ["the", " cat", "'s", "'re", "  ", "\n", "\n\n", "\t", " 12", "éà", "漢字", "  ", "😀", "႔0", "<|endoftext|>", "<|", "!", "...", "\x1c", " ", "\x85", "\x00", "a"]
    return ["", "x", "<|endoftext|>", "<|endoftext|><|endoftext|> a", " " * 50] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def run(spark, rows, **how):
    """Rows as (doc_id, text); they pass through a file, as encoding reads its table twice."""
    enc = bpe.encode(rows, PATH, **how)
    out = enc.withColumn("bytes", bpe.decoded_bytes(F.col("ids"), PATH))
    return [(r["doc_id"], r["ids"], bytes(r["bytes"]), r["text"]) for r in bpe.decode(out, PATH).collect()]


def test_ids_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, None), (None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, ids string").repartition(3, "doc_id")
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, (t or "").encode()) for i, t in rows), key=str)
    for limit in (bpe.CHUNK_BYTES, 200):
        got = run(spark, df, chunk_bytes=limit)
        assert sorted(((i, ids, b) for i, ids, b, _ in got), key=str) == want
        assert all(t == b.decode() for _, _, b, t in got)
    assert run(spark, df.limit(0)) == []


def test_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {i: (ids, b) for i, ids, b, _ in run(spark, docs)}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (library.encode(r["text"], add_special_tokens=False).ids, r["text"].encode())


def test_a_very_long_text(spark, library):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma1", "\n"]) + str(rng.randrange(999)) for _ in range(60000))
    (row,) = run(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert row[1] == library.encode(text, add_special_tokens=False).ids and row[2].decode() == text


def test_changed_input_is_refused(spark):
    noise = F.udf(lambda: str(random.SystemRandom().random()), "string").asNondeterministic()
    docs = spark.range(200).select(F.col("id").alias("doc_id"), noise().alias("text"))
    with pytest.raises(Exception, match="changed between two readings"):
        bpe.encode(docs, PATH).count()


def test_splitter_keeps_every_character():
    split = bpe.Splitter(["<|endoftext|>"])
    for t in texts():
        assert "".join(split(t)) == t and regex.compile(bpe.PATTERN)
