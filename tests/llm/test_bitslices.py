import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nearpass.llm import bitslices as bs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def direct(docs, items, k=10):
    held = [(i, c) for i, t in docs if (c := terms(t))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if i is not None and s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, **how):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string")
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bs.search(d.repartition(3), q, **how).collect())


def corpus(n, seed, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice((1, 5, 40, 400))))) for i in range(n)]


def test_ranks_as_brute_force(spark):
    docs = corpus(300, 1)
    docs += [(i + 300, docs[7][1]) for i in range(40)]  # copies tie
    items = [(i, " ".join(t.split()[:25])) for i, t in corpus(12, 2)] + [(99, docs[7][1]), (100, "w250 w251"), (101, "w0"), (102, "unknown")]
    assert run(spark, docs, items) == direct(docs, items)
    assert run(spark, docs, items, k=3) == direct(docs, items, 3)


def test_filters_overestimate_and_bounds_hold():
    texts = [bs.count_terms(t.encode()) for _, t in corpus(60, 3)]
    asked = [bs.count_terms(b"w0 w1 w5 w17 w200"), bs.count_terms(b"w3 w4 zz")]
    names = sorted(set().union(*asked))
    q = bs.Queries(names, [np.array([names.index(t) for t in a]) for a in asked], np.arange(1, len(names) + 1, dtype=float), 60, sum(t.total() for t in texts))
    rows = 256
    bits = np.zeros((rows, 64), np.uint8)
    for column, t in enumerate(texts):
        bits[bs.places(bs.keys_of(t), rows).ravel(), column] = 1
    lens = np.array([t.total() for t in texts])
    bounds = q.bounds(rows, lens, np.packbits(bits, axis=1).tobytes())
    for i in range(2):
        assert all(bounds[i, d] >= q.score(i, t, q.shortness(t.total())) for d, t in enumerate(texts))


def test_terms_of_pieces(monkeypatch):
    text = ("Straße É9_x " * 50 + "A" * 40 + " end").encode()
    whole = bs.count_terms(text)
    for size in (1, 7, 16):
        monkeypatch.setattr(bs, "PIECE", size)
        assert bs.count_terms(text) == whole
    assert whole == {t.encode(): n for t, n in terms(text.decode()).items()}


def test_odd_rows_and_blocks_of_queries(spark, monkeypatch):
    docs = [(1, "alpha beta"), (1, "alpha"), (2, None), (3, ""), (4, "..."), (None, "alpha alpha"), (5, "ALPHA beta-gamma"), (6, "Alpha " * 5000)]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "Beta gamma beta"), (None, "gamma")]
    monkeypatch.setattr(bs, "QUERY_BYTES", 40)
    got = run(spark, docs, [i for i in items if i[0] is not None])
    assert got == direct(docs, [i for i in items if i[0] is not None])
    df = spark.createDataFrame(items[-1:], "query_id long, text string")
    assert [r["doc_id"] for r in bs.search(spark.createDataFrame(docs, "doc_id long, text string"), df).collect()] == [5]


def test_join_beyond_the_broadcast_bound_clashing_names_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(bs, "BROADCAST_PAIRS", -1)
    docs, items = corpus(50, 5), [(1, "w0 w9 w30"), (2, "w2")]
    assert run(spark, docs, items) == direct(docs, items)
    odd = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("id", "queries", "rows", "score", "query")])
    queries = spark.createDataFrame(items, "query_id long, text string").select("*", F.lit(1).alias("doc_id"), F.lit(2).alias("query"))
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bs.search(odd, queries).collect()) == direct(docs, items)
    assert bs.search(odd.limit(0), queries).count() == 0 and bs.search(odd, queries.limit(0)).count() == 0
