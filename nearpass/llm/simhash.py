"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most four bits differ in at most one bit of some segment when the bits are cut
into three (three segments with two differences each would make six). Each segment is therefore indexed under one signature
per wildcard position: the segment with that bit cleared, and the position. Fingerprints whose segments agree but for one
bit share a signature, so candidates come from an equality join and are verified by counting differing bits.

Equal fingerprints are one node of the link graph, so copies are never expanded into pairs.

Null or empty text and text without a word have the fingerprint zero, which is linked like any other. Rows with a null id
take part in links and get the smallest id of their component (null if it has none). Repeated rows are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from nearpass.llm.common import checkpointed, components, flat, unused

BITS = 64
MAX_BITS = 4
SEGMENTS = 3


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    hash64 = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), (ends[min(width, len(words)) - 1:] - 1).tolist())
    hashes = np.array([hash64(joined[a:b], seed) for a, b in pairs], dtype=">u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        counts += np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_udf(width: int = 4, seed: int = 42):
    """Arrow function from text to the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        data, at = flat(texts)
        body = data.tobytes()
        values = [fingerprint(body[a:b], width, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return simhash


def signatures(fp: Column, segments: int = SEGMENTS) -> Column:
    """Array of the signatures of a fingerprint: segment values with one bit cleared, tagged with that bit's number."""
    out = []
    bounds = [BITS * i // segments for i in range(segments + 1)]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        value = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        for j in range(hi - lo):
            cleared = value.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << j)))
            out.append(F.shiftleft(F.lit(lo + j).cast("long"), 32).bitwiseOR(cleared))
    return F.array(*out)


def _meeting_place(difference: Column, segments: int) -> Column:
    """Number of the one signature at which a pair is reported: in the first segment that differs by at most one bit, that bit or the segment's first."""
    place = F.lit(None).cast("int")
    bounds = [BITS * i // segments for i in range(segments + 1)]
    for lo, hi in reversed(list(zip(bounds[:-1], bounds[1:]))):
        part = F.shiftrightunsigned(difference, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        at = F.when(part == 0, lo).otherwise(F.bit_count(part - 1) + lo)
        place = F.when(F.bit_count(part) <= 1, at).otherwise(place)
    return place


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in column fp that differ in at most ``max_bits`` bits; each pair once."""
    segments = max_bits // 2 + 1  # the fewest for which one segment differs by one bit at most
    index = fps.select("fp", F.explode(signatures(F.col("fp"), segments)).alias("sig"))
    left, right = index.select(F.col("fp").alias("a"), "sig"), index.select(F.col("fp").alias("b"), "sig")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(difference) <= max_bits) & (F.shiftright("sig", 32) == _meeting_place(difference, segments))
    return left.hint("merge").join(right.hint("merge"), "sig").filter(near).select("a", "b")


def _rooted(docs: DataFrame, text: str, doc_id: str, width: int, seed: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, t, fp) of every document, t the hash of its text, and (fp, least, root) of every fingerprint."""
    own = checkpointed(docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), fingerprint_udf(width, seed)(F.col(f"`{text}`")).alias("fp")))
    nodes = checkpointed(own.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    return own, checkpointed(nodes.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, seed: int = 42,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable)."""
    own, rooted = _rooted(docs, text, doc_id, width, seed, max_bits)
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a large component is one hot root: as a stage of its own the join can be split
    label = checkpointed(rooted.join(best, "root").select("fp", "component_id"))
    return own.join(label, "fp").select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with its columns: the one with the smallest id, or one without an id if none has one."""
    own, rooted = _rooted(docs, text, doc_id, width, seed, max_bits)
    first = own.groupBy("fp").agg(F.min(first_key()).alias("first")).join(rooted, "fp")
    return keep_first(docs, first.groupBy("root").agg(F.min("first").alias("first")), text, doc_id)


def first_key() -> Column:
    """Least for the document of a component that is kept: smallest id, then smallest hash of the text; those without an id come last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "t")


def keep_first(docs: DataFrame, first: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with the id and text hash of some ``first``, each once. An id may repeat, or be null, with texts of several components."""
    mine, own = unused(docs, "_id"), unused(docs, "_text_hash")
    hashed = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    there = unused(hashed, "_t")
    chosen = first.select(F.col("first.id").alias(mine), F.col("first.t").alias(there))
    kept = hashed.join(chosen.hint("merge"), F.col(f"`{doc_id}`").eqNullSafe(F.col(mine)) & (F.col(own) == F.col(there)), "left_semi")
    return kept.dropDuplicates([doc_id, own]).drop(own)
