"""Ranked lexical search over bit-sliced Bloom signatures, exact.

Terms are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z in lower case. A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1)));
a document of n terms has m = 10 + 90 n N div L; the term adds w * (10^9 tf div (1000 tf + 8 m)) to the score. N documents have a term, L terms in all.

1. The index: documents of about as many distinct terms share a block. A block is a bit matrix: a column per document, a row (slice) per place of
   its Bloom filters. A document's filter holds its terms, and again under other hashes those that occur 2, 3, 4, 6, 9 or 14 times.
2. Queries come in blocks of bounded size. One pass counts the documents that have their terms.
3. The slices of a term, combined by AND, are a bitmap of the documents that may have it, never too few. Weighted sums of the
   bitmaps of a query's terms, level by level, times what the level's largest frequency is worth at the document's length, bound its score from above.
4. The documents of the largest bounds are scored exactly; the k-th score found so is the threshold. All documents whose bound reaches it
   are scored exactly from their texts. What is left out is proven to be below the k-th score.

Null and empty texts, and texts without a term, have no term: they do not count and are not found. Rows with a null id count in N, L and df but are
not found. Rows that repeat an id count and are found one by one. Queries without a term get no row; queries with equal ids are answered
one by one. Texts of any length are counted in pieces. An empty table finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from nearpass.llm.common import checkpointed, flat, stored

LEVELS = (1, 2, 3, 4, 6, 9, 14)
KEY_BITS, HASHES = 8, 5
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 1024
QUERY_BYTES = 1 << 20
PROBES = 4
BROADCAST_PAIRS = 500_000
PIECE = 1 << 20
MERGES = 64

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def count_terms(text: bytes) -> Counter:
    """Terms of a text and how often each occurs."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + PIECE
        rest = _TERM.match(text, end)  # a piece ends with a term
        end = rest.end() if rest else end
        found.update(_TERM.findall(text[at:end].lower()))
        at = end
    return found


def places(keys: np.ndarray, rows: int) -> np.ndarray:
    """Places of the filters of ``rows`` bits for every hashed key: (keys, HASHES)."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(rows)).astype(np.int64)


def keys_of(terms: Counter) -> np.ndarray:
    """Hashes of a document's filter: each term once per level that its frequency reaches."""
    key = xxhash.xxh64_intdigest
    return np.array([key(t, level) for t, n in terms.items() for level in LEVELS if level <= n], np.uint64)


def _texts(batch: pa.RecordBatch, column: int):
    data, at = flat(batch.column(column))
    return (data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks (rows, ids, lens, slices): number of slices, ids and numbers of terms of the documents, packed bits slice by slice."""
    kind = docs.schema[doc_id].dataType
    arrow = pa.int32() if kind.simpleString() == "int" else pa.int64()

    def block(rows: int, members: list) -> pa.RecordBatch:
        bits = np.zeros((rows, -(-len(members) // 8) * 8), np.uint8)
        for column, (_, _, keys) in enumerate(members):
            bits[places(keys, rows).ravel(), column] = 1
        ids, lens = pa.array([[i for i, _, _ in members]], pa.list_(arrow)), pa.array([[n for _, n, _ in members]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), ids, lens, pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())],
                                          names=["rows", "ids", "lens", "slices"])

    def build(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                terms = count_terms(body)
                if not terms:
                    continue
                keys = keys_of(terms)
                rows = 1 << max(6, (KEY_BITS * len(keys) - 1).bit_length())
                members = waiting.setdefault(rows, [])
                members.append((i, terms.total(), keys))
                if len(members) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // rows)):
                    yield block(rows, waiting.pop(rows))
        for rows, members in waiting.items():
            yield block(rows, members)

    parts = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(build, f"rows long, ids array<{kind.simpleString()}>, lens array<long>, slices binary")
    return stored(parts, "slices")


@dataclass
class Queries:
    """A block of queries: their distinct terms with weights, and each query's term numbers."""

    terms: list[bytes]
    asked: list[np.ndarray]
    weight: np.ndarray
    n_docs: int
    n_terms: int

    def __post_init__(self):
        self.keys = [np.array([xxhash.xxh64_intdigest(t, level) for t in self.terms], np.uint64) for level in LEVELS]
        self.worth = [[(self.terms[t], int(self.weight[t])) for t in ts.tolist()] for ts in self.asked]

    def shortness(self, n):
        return 10 + 90 * n * self.n_docs // self.n_terms

    def score(self, query: int, terms: Counter, m: int) -> int:
        return sum(w * (1_000_000_000 * tf // (1000 * tf + 8 * m)) for t, w in self.worth[query] if (tf := terms.get(t)))

    def bounds(self, rows: int, lens: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores of a block's documents: (queries, documents)."""
        bits = np.frombuffer(slices, np.uint8).reshape(rows, -1)
        m = self.shortness(lens)
        out = np.zeros((len(self.asked), len(lens)), np.int64)
        alive, seen, before = np.arange(len(self.terms)), None, 0
        for level, keys in enumerate(self.keys):
            at = places(keys[alive], rows)
            there = bits[at[:, 0]]
            for j in range(1, HASHES):
                there &= bits[at[:, j]]
            if seen is not None:
                there &= seen
            some = there.any(axis=1)
            alive, seen = alive[some], there[some]
            if not len(alive):
                break
            most = np.minimum(lens, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else lens
            value = 1_000_000_000 * most // (1000 * most + 8 * m)
            gain, before = value - before, value
            number = np.full(len(self.terms), -1)
            number[alive] = np.arange(len(alive))
            for q, terms in enumerate(self.asked):
                mine = terms[number[terms] >= 0]
                if len(mine):
                    held = np.unpackbits(seen[number[mine]], axis=1, count=len(lens))
                    out[q] += (self.weight[mine] @ held.astype(np.float64)).astype(np.int64) * gain
        return out


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            rows, ids, lens, slices = (batch.column(c)[i] for c in range(4))
            yield rows.as_py(), ids.values, lens.values.to_numpy(), slices.as_buffer()


def _document_counts(docs: DataFrame, text: str, terms: list[bytes]) -> np.ndarray:
    """Number of documents that have each term."""
    number = {t: i for i, t in enumerate(terms)}

    def count(batches):
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for body in _texts(batch, 0):
                found[[number[t] for t in number.keys() & count_terms(body).keys()]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]  # terms of a block of queries at most
    return out


def _best_bounds(index: DataFrame, asked, kind: str, n: int) -> DataFrame:
    """(id, query) of the ``n`` largest bounds of every query."""

    def best(batches):
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked.value.asked]
        for rows, ids, lens, slices in _blocks(batches):
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for q, bound in enumerate(asked.value.bounds(rows, lens, slices)):
                some = np.flatnonzero(known & (bound > 0))
                i, b = np.append(top[q][0], ids[some]), np.append(top[q][1], bound[some])
                if len(b) > n:
                    keep = np.argpartition(-b, n)[:n]
                    i, b = i[keep], b[keep]
                top[q] = i, b
        number = np.repeat(np.arange(len(top), dtype=np.int32), [len(i) for i, _ in top])
        i, b = (np.concatenate([t[c] for t in top]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(number), pa.array(b), pa.array(i % MERGES)], names=["id", "query", "bound", "lot"])

    rows = index.mapInArrow(best, "id long, query int, bound long, lot long")
    for by in (["query", "lot"], ["query"]):
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("bound"), "id"))).filter(F.col("nth") <= n)
    return rows.select(F.col("id").cast(kind).alias("id"), "query")


def _reaching(index: DataFrame, asked, kind: str, threshold: list[int]) -> DataFrame:
    """(id, query) of every bound that reaches its query's threshold."""
    least = np.array(threshold, np.int64)[:, None]

    def reach(batches):
        for rows, ids, lens, slices in _blocks(batches):
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            query, at = np.nonzero((asked.value.bounds(rows, lens, slices) >= least) & known)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(query.astype(np.int32))], names=["id", "query"])

    return index.mapInArrow(reach, f"id {kind}, query int")


def _scored(docs: DataFrame, pairs: DataFrame, asked, text: str, doc_id: str) -> DataFrame:
    """(query, id, score) of the rows of every pair, from their texts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = checkpointed(pairs.groupBy("id").agg(F.collect_set("query").alias("queries")))
    if (wanted.agg(F.sum(F.size("queries") + 1).alias("n")).first()["n"] or 0) <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(wanted, "id").select("id", "queries", "text")

    def score(batches):
        for batch in batches:
            row, number, value = [], [], []
            for at, (queries, body) in enumerate(zip(batch.column(1).to_pylist(), _texts(batch, 2))):
                terms = count_terms(body)
                m = asked.value.shortness(terms.total())
                for q in queries:
                    row.append(at)
                    number.append(q)
                    value.append(asked.value.score(q, terms, m))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), batch.column(0).take(pa.array(row, pa.int32())), pa.array(value, pa.int64())], names=["query", "id", "score"])

    return rows.mapInArrow(score, f"query int, id {kind}, score long").filter("score > 0")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "query_id",
           index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query, equal scores by ascending id. Document ids are integers."""
    spark = docs.sparkSession
    index = build_index(docs, text, doc_id) if index is None else index
    whole = index.agg(F.sum(F.size("lens")).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("terms")).first()
    n_docs, n_terms = whole["n"] or 0, whole["terms"] or 1
    kind = docs.schema[doc_id].dataType.simpleString()
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{query_text}`").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n_blocks = -(-size // QUERY_BYTES)
    results = [spark.createDataFrame([], f"query_id {queries.schema[query_id].dataType.simpleString()}, rank int, doc_id {kind}, score long")]
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id", "text"), F.lit(n_blocks)) == b).orderBy("query_id", "text").collect()  # QUERY_BYTES on average
        if not block:
            continue
        texts = [count_terms((r["text"] or "").encode()) for r in block]
        terms = sorted(set().union(*texts))
        number = {t: i for i, t in enumerate(terms)}
        df = _document_counts(docs, text, terms)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.float64)
        of = spark.sparkContext.broadcast(Queries(terms, [np.array(sorted(number[t] for t in ts), np.int64) for ts in texts], weight, n_docs, n_terms))
        probed = _ranked(_scored(docs, _best_bounds(index, of, kind, PROBES * k), of, text, doc_id), k)
        threshold = [1] * len(block)
        for r in probed.filter(F.col("rank") == k).select("query", "score").collect():  # one row per query of the block
            threshold[r["query"]] = r["score"]
        found = checkpointed(_ranked(_scored(docs, _reaching(index, of, kind, threshold), of, text, doc_id), k))
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"query int, query_id {queries.schema[query_id].dataType.simpleString()}")
        results.append(found.join(F.broadcast(names), "query").select("query_id", "rank", F.col("id").alias("doc_id"), "score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionAll(r)
    return out
