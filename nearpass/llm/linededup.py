"""Line deduplication over hashes in ranges, with a keep bitmap per document.

DataFrame operations only. A line's key is the line without the ASCII blanks at its ends, A-Z in lower case; keys shorter than
``least_chars`` code points are never dropped. Keys are known by 128 bits of hashes, a document by its id and a hash of its text.

1. Lines become rows (hash, document, position) without their text. They are dealt by ranges of (hash, document), so a line that a third
   of all documents share lies in many partitions, and sorted there by hash, document and position.
2. The sorted rows are streamed: the first line of each (hash, document) counts for its document. The counts of a hash are summed per
   partition before they are shuffled. Hashes of at least ``min_docs`` documents are the frequent ones.
3. The lines of frequent hashes set bits in words of 64 lines of their document. Only words in which a line goes are kept: the keep bitmap
   of a document is the list (word, bits), all other bits are one.

The frequent hashes are broadcast up to ``BROADCAST_KEYS``; beyond that they are joined by their hashes.

Null and empty texts are one empty line, which stays. Rows that repeat both id and text are one document: counted once, and each of them
gets the same bitmap. Null ids are ids like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from nearpass.llm.common import checkpointed, unused

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_KEYS = 200_000
WORD = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """Columns that tell documents apart."""
    return F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t")


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 1) -> DataFrame:
    """(h1, h2, id, t, pos): the keys of all lines, without their text."""
    keys = F.transform(_lines(F.translate(F.col(f"`{text}`"), UPPER, LOWER)), lambda line: F.btrim(line, F.lit(BLANKS)))
    # the outer form has no filter on the array, which would cut every text twice; a text has a line at least
    lines = docs.select(*_document(docs, text, doc_id), F.posexplode_outer(keys).alias("pos", "key"))
    return lines.filter(F.char_length("key") >= least_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "t", "pos")


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, first): keys of at least ``min_docs`` documents, how many, and the first (id, t, pos) that has one."""
    place = ["h1", "h2", "id", "t"]
    dealt = lines.repartitionByRange(*place).sortWithinPartitions(*place, "pos")
    first = dealt.withColumn("nth", F.row_number().over(W.partitionBy(*place).orderBy("pos"))).filter("nth = 1")
    return first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "t", "pos")).alias("first")).filter(F.col("n") >= min_docs)


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 2, least_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """(id, t, keep) of the documents that lose lines: id, hash of the text, and array of (word, bits), bit i of a word one if line 64 * word + i stays.

    A key of at least ``min_docs`` documents loses all its lines, or all but the first by (id, text hash, position) with ``keep_first``.
    """
    lines = occurrences(docs, text, doc_id, least_chars)
    keys = checkpointed(frequent_keys(lines, min_docs))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    gone = lines.join(keys, ["h1", "h2"])
    if keep_first:
        gone = gone.filter(~F.struct("id", "t", "pos").eqNullSafe(F.col("first")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(WORD)).cast("int"))
    words = gone.groupBy("id", "t", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents with ``kept_text``, ``n_lines`` and ``n_dropped``; columns of these names are replaced."""
    new = ["kept_text", "n_lines", "n_dropped"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c in (text, doc_id)]
    mine, hashed, bits, words = (unused(docs, c) for c in ("_id", "_t", "_bits", "_words"))
    last = lambda i: F.when(i > 0, F.get("keep", i - 1)["word"]).otherwise(-1)
    gap = lambda x, i: F.array_repeat(F.lit(-1).cast("long"), x["word"] - last(i) - 1)
    dense = F.flatten(F.transform("keep", lambda x, i: F.concat(gap(x, i), F.array(x["bits"]))))
    lost = F.aggregate("keep", F.lit(0).cast("long"), lambda n, x: n + WORD - F.bit_count(x["bits"]))
    ready = bitmaps.select(F.col("id").alias(mine), F.col("t").alias(hashed), dense.alias(bits), lost.alias(words))
    both = docs.join(ready, F.col(f"`{doc_id}`").eqNullSafe(F.col(mine)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(hashed)), "left")
    lines = _lines(F.col(f"`{text}`"))
    word = lambda i: F.coalesce(F.get(bits, F.floor(i / WORD).cast("int")), F.lit(-1).cast("long"))
    stays = lambda line, i: F.call_function("shiftright", word(i), F.pmod(i, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1)) == 1
    rest = F.when(F.col(bits).isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return both.select(*kept, rest.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(words, F.lit(0).cast("long")).alias("n_dropped"))


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 2, least_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Documents without the lines that :func:`keep_bitmaps` drops."""
    return apply_bitmaps(docs, keep_bitmaps(docs, text, doc_id, min_docs, least_chars, keep_first), text, doc_id)
