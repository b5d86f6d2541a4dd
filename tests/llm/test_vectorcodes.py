import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nearpass.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def direct(vectors, parts, entries, rounds):
    """Codes, errors and codebooks in plain loops."""
    rows = [[math.floor(4096 * float(np.float32(x))) for x in v] for v in vectors]
    wide = len(rows[0]) // parts
    cut = lambda r, p: r[p * wide:(p + 1) * wide]
    books = [[cut(r, p) for r in rows[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in rows:
                own[nearest(cut(r, p), books[p])[1]].append(cut(r, p))
            books[p] = [[sum(c) // len(c) for c in zip(*mine)] if mine else e for mine, e in zip(own, books[p])]
    found = [[nearest(cut(r, p), books[p]) for p in range(parts)] for r in rows]
    return [[i for _, i in f] for f in found], [sum(d for d, _ in f) for f in found], books


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, 0.01, (n, dims)), 3).astype(np.float32).tolist()


@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=16), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_orchard_search_finds_the_nearest(entries, points):
    """Equal entries and equal distances included: the lower index wins."""
    book, x = vc.Codebook(np.array(entries, np.int64)), np.array(points, np.int64)
    best, error = book.nearest(x)
    apart = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    assert best.tolist() == apart.argmin(axis=1).tolist() and error.tolist() == apart.min(axis=1).tolist()


def test_codes_errors_and_codebooks(spark):
    data = vectors(120, 24, 1)
    rows = vc.whole_vectors(spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(data)], SCHEMA).repartition(5))
    books = vc.train(rows, 8, 16, 6)
    codes, errors, want = direct(data, 8, 16, 6)
    assert [b.tolist() for b in books] == want
    got = {r["id"]: r for r in vc.with_label_error(vc.encode(rows, books)).collect()}
    assert [got[i]["codes"] for i in range(120)] == codes and [got[i]["error"] for i in range(120)] == errors
    assert [got[i]["label_error"] for i in range(3)] == [sum(errors[k::3]) for k in range(3)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 8, None), (1, [0.25] * 8, None), (1, [0.25] * 8, 2), (None, [-0.1] * 8, 2), (4, None, 1), (5, [nan] + [0.0] * 7, 1), (6, [inf] * 8, 1), (7, [None] + [0.0] * 7, 1),
            (8, [1e9] * 8, 1), (9, [0.1] * 16, 1), (10, [], 1)]
    good = vc.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    books = vc.train(good)
    got = sorted(((r["id"], r["label"], r["error"], r["label_error"]) for r in vc.with_label_error(vc.encode(good, books)).collect()), key=str)
    assert [b.shape for b in books] == [(4, 1)] * 8  # the null id is the last entry
    assert got == [(1, 2, 0, 0), (1, None, 0, 0), (3, None, 0, 0), (None, 2, 0, 0)]


def test_no_vector(spark):
    none = spark.createDataFrame([(1, None, 1)], SCHEMA)
    rows = vc.whole_vectors(none)
    assert vc.train(rows) == [] and vc.with_label_error(vc.encode(rows, [])).count() == 0


def test_clashing_names_and_labels_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST_LABELS", -1)
    data = vectors(20, 8, 2)
    df = spark.createDataFrame([(i, v, None if i % 2 else 5) for i, v in enumerate(data)], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "x", "codes", "error", "_label")])
    rows = vc.whole_vectors(df)
    got = vc.with_label_error(vc.encode(rows, vc.train(rows))).collect()
    _, errors, _ = direct(data, 8, 16, 6)
    assert {(r["label"], r["label_error"]) for r in got} == {(5, sum(errors[::2])), (None, sum(errors[1::2]))}
