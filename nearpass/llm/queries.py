"""Queries of the corpus operators. Each applies its operator to the whole table with the parameters meant for production."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearpass.llm import bitslices, bpe, langid, linededup, mixing, repetition, search, sharding, simhash, tokencount, toxicity, urls, vectorcodes
from nearpass.llm.sql import BM25, LEXICAL, LINE_DEDUP, URL_FILTER, VECTOR_CODES
from nearpass.llm.common import held_out, table

#: Vocabulary of the registered queries; operators take any file's path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    net = langid.train(langid.learnable(docs))
    return langid.identify(docs.select("doc_id", "text", held_out().alias("held_out")), net).drop("text")


@query
def op2_url_filter(spark, sf_dir):
    """Rule and template verdict of every page. A page is labelled through the document whose id its path ends with."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = urls.host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]+)(?:\.[a-z]+)?/?$", 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    keyed = pages.withColumn("doc_id", F.when(number != "", number.try_cast("bigint")))
    labelled = keyed.join(labels, "doc_id", "left").drop("doc_id")
    return urls.judge(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


SQL["op2_url_filter"] = URL_FILTER


@query
def op3_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.log_model(toxicity.trigram_counts(docs))
    evidence = toxicity.train(docs, labels.filter(~held_out()), model)
    return toxicity.score(docs.select("doc_id", "text", held_out().alias("held_out")), evidence, model).drop("text")


@query
def op5_quality_rules(spark, sf_dir):
    """Repetition figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                         "covered_words", "longest_repeat")


@query
def op6_token_counts(spark, sf_dir):
    """Token counts of every document before and after three edits at places that its id decides: an insertion, a deletion, a replacement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.coalesce(F.length("text"), F.lit(0)) + 1).cast("int").alias("start")
    edit = lambda k, drop, put: F.struct(place(k), F.lit(drop).alias("drop"), F.lit(put).alias("put"))
    edits = F.array(edit(1, 0, " (revised)"), edit(2, 25, ""), edit(3, 7, "new words, new counts"))
    trees = tokencount.build_trees(docs, TOKENIZER)
    done = tokencount.apply_edits(trees.withColumn("edits", edits), TOKENIZER)
    return done.select("doc_id", F.size("edits").cast("long").alias("n_edits"), "n_tokens_before", "n_tokens_after", "words_encoded", "words_after")


@query
def op7_bpe(spark, sf_dir):
    """Digests of every document's token ids and of the text decoded from them."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER)
    text = bpe.decode(encoded, TOKENIZER)
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))


@query
def op8_sharding(spark, sf_dir):
    """Shard and slot of every document among eight shards."""
    done = sharding.shards(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_mixing(spark, sf_dir):
    """Sampling probability and draw of every document after raking to source, language and topic."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "probability", "draw", "sampled", "converged")


@query
def op4_bm25(spark, sf_dir):
    """The ten documents most like each document whose id is divisible by 20, by all terms of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(docs, docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


SQL["op4_bm25"] = BM25


@query
def op13_line_dedup(spark, sf_dir):
    """Lines of every document before and after lines that ten documents share go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.drop_lines(docs, min_docs=10, least_chars=1, keep_first=False)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op13_line_dedup"] = LINE_DEDUP


@query
def op11_orchard_codes(spark, sf_dir):
    """Product codes of all vectors, their errors and a digest of the codebooks."""
    rows = vectorcodes.whole_vectors(table(spark, sf_dir, "embeddings"))
    books = vectorcodes.train(rows)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    done = vectorcodes.with_label_error(vectorcodes.encode(rows, books))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return done.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


SQL["op11_orchard_codes"] = VECTOR_CODES


@query
def op12_lexical_search(spark, sf_dir):
    """The ten documents of highest score for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return bitslices.search(docs, items, query_id="item_id").withColumnRenamed("query_id", "item_id")


SQL["op12_lexical_search"] = LEXICAL
