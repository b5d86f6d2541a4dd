"""Raking and sampling against direct computation."""

import hashlib
import random

import pytest

from nearpass.llm import mixing

SF = "/root/testdata/sf0.001"


def raked(rows, share, temper, sweeps=mixing.SWEEPS):
    """Weights of cells {(source, lang, topic): tokens} by plain iterative proportional fitting with caps."""
    total = sum(rows.values())
    targets = []
    for m in range(3):
        sums = {}
        for c, t in rows.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        norm = sum(v ** temper for v in sums.values())
        targets.append({k: v ** temper / norm * total * share for k, v in sums.items()})
    w = dict(rows)
    for _ in range(sweeps):
        for m in range(3):
            sums = {}
            for c, v in w.items():
                sums[c[m]] = sums.get(c[m], 0) + v
            w = {c: min(rows[c], v * targets[m][c[m]] / sums[c[m]]) for c, v in w.items()}
    return w, targets


def check(df, share=mixing.SAMPLE_SHARE, temper=mixing.TEMPER):
    got = df.collect()
    cells = {}
    for r in got:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["tokens"]
    w, _ = raked(cells, share, temper)
    for r in got:
        c = (r["source"], r["lang"], r["topic"])
        assert r["probability"] == pytest.approx(w[c] / cells[c], rel=1e-4, abs=1e-6)
        key = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"1|{key}".encode()).hexdigest()[:12], 16) / 2 ** 48
        assert r["draw"] == u and r["sampled"] == (u < r["probability"]) and r["tokens"] == max(1, len((r["text"] or "").split()))
    return got


def test_table(spark):
    got = check(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")))
    assert all(r["converged"] for r in got)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["s1", "s2", None, ""]), rng.choice(["en", "de", None]), " ".join(rng.choice(["alpha12", "beta345", "gamma6", "xx"]) for _ in range(rng.randrange(0, 50))))
            for i in range(200)] + [(None, "s1", "en", None), (None, "s1", "en", None), (1, None, None, ""), (1, None, None, ""), (300, "s2", "de", "longword " * 50000)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, source string, lang string, text string, tokens string, draw int")
    check(mixing.mix(df))
    kept = mixing.keep_sampled(df)
    assert kept.columns == df.columns and kept.schema == df.schema and 0 < kept.count() < len(rows) and {r["tokens"] for r in kept.collect()} == {"x"}
    assert mixing.mix(df.limit(0)).count() == 0


def test_margins_are_met(spark):
    docs = mixing.describe(spark.read.parquet(f"{SF}/documents.parquet"))
    cells = mixing.cells(docs)
    w = mixing.rake(mixing.tempered(cells, mixing.MARGINS, 0.5, 0.7)).collect()
    assert w[0]["converged"] and all(r["weight"] <= r["tokens"] * (1 + 1e-9) for r in w)
    for m in mixing.MARGINS:
        sums, target = {}, {}
        for r in w:
            sums[r[m]] = sums.get(r[m], 0) + r["weight"]
            target[r[m]] = r[f"target_{m}"]
        assert all(sums[k] == pytest.approx(target[k], rel=1e-5) for k in sums)
