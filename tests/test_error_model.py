"""Dead-reckoning samples without one row per horizon before the join, and medians found where a sample points."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.operators import probability as pb, quantiles as qt

COLS = "day string, leg bigint, t bigint, x double, y double, h double, vx double, vy double, vz double, track double, phase bigint"


def _states(spark):
    rnd = random.Random(4)
    rows = [("d", leg, t, rnd.random(), rnd.random(), 100 * rnd.random(), 0.01, -0.02, 1.0, 90.0 * leg, (0, 3, 105)[leg % 3])
            for leg in range(3) for t in range(1000, 1700) if rnd.random() < 0.3]
    return rows + rows[5:9], spark.createDataFrame(rows + rows[5:9], COLS)  # a second may occur twice


def test_error_samples_meet_every_later_state(spark):
    rows, df = _states(spark)
    out = pb.error_samples(df, df)
    got = sorted((r.leg, r.t0, r.tau, round(r.e_z, 6)) for r in out.collect())
    want = sorted((a[1], a[2], b[2] - a[2], round(b[5] - a[5] - a[8] * (b[2] - a[2]), 6))
                  for a in rows for b in rows if a[1] == b[1] and b[2] - a[2] in range(10, 181, 10))
    assert got == want


def test_error_samples_write_no_row_per_horizon(spark):
    _, df = _states(spark)
    plan = pb.error_samples(df, df)._jdf.queryExecution().analyzed().toString()
    assert "explode(sequence(" not in plan


@pytest.mark.parametrize("by", [["i"], ["side"]])
def test_guided_quantile_is_exact(spark, by):
    """``side`` makes a sample of the smallest values only, so that the ranks lie outside the guessed intervals."""
    rnd = random.Random(7)
    values = sorted([rnd.gauss(0, 1e-12) for _ in range(20_000)] + [0.0] * 9_000 + [rnd.uniform(-9, 9) for _ in range(11_000)])
    rows = [(k % 2, i, v, None if i % 5 == 0 else float("nan") if i % 5 == 1 else abs(v)) for i, v in enumerate(values) for k in (i,)]
    low = next(k for k in range(99) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(8))).first()[0] == 0)
    high = next(k for k in range(99) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(8))).first()[0] != 0)
    df = spark.createDataFrame([(*r, low if r[1] < 9_000 else high) for r in rows], "g int, i int, v double, w double, side int")
    got = {r.g: r for r in qt.guided_quantile(df, ["v", "w"], 0.5, ["g"], by=by, part=8, gathered=100, buckets=16).collect()}
    for g in (0, 1):
        v = [r[2] for r in rows if r[0] == g]
        w = [r[3] for r in rows if r[0] == g and r[3] is not None and r[3] == r[3]]
        assert got[g].n == len(v)
        assert (got[g].v, got[g].w) == (pytest.approx(np.median(v), rel=1e-12, abs=0), pytest.approx(np.median(w), rel=1e-12, abs=0))


def test_error_model_stores_no_samples(spark, monkeypatch):
    """The samples outnumber the aircraft-seconds by the horizons; what is written must not."""
    _, df = _states(spark)
    samples = pb.error_samples(df, df)
    total, stored = samples.count(), []

    def cut(one, old=pb.cut_lineage):
        done = old(one)
        stored.append(done.count())
        return done

    monkeypatch.setattr(pb, "cut_lineage", cut)
    pb.fit_error_model(samples).collect()
    assert max(stored) < total / 10


def _model(df):
    return {(r.phase, r.tau_s): (r.n, r.sigma_along_nm, r.sigma_cross_nm, r.sigma_z_ft) for r in df.collect()}


def test_error_model_of_states_equals_that_of_samples(spark, monkeypatch):
    """Legs cut between two batches, seconds that occur twice, rows without a phase, missing values."""
    monkeypatch.setattr(pb, "TOGETHER", 64)
    monkeypatch.setattr(pb, "SAMPLED", 4)
    rows, _ = _states(spark)
    rows = [(*r[:4], None if i % 17 == 0 else r[4], *r[5:10], None if i % 5 == 0 else r[10]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, COLS)
    want = _model(pb.fit_error_model(pb.error_samples(df, df.filter("phase is not null"))))
    got = _model(pb.error_model(df))
    assert got.keys() == want.keys() and len(got) == 4 * 18
    for k, v in want.items():
        assert got[k] == (v[0], *[x if x is None else pytest.approx(x, rel=1e-9) for x in v[1:]])


def test_error_model_whose_sample_misleads(spark, monkeypatch):
    """Intervals without the ranks: the samples are taken after all."""
    _, df = _states(spark)
    old, taken = pb.guides, []
    monkeypatch.setattr(pb, "guides", lambda *a: old(*a).withColumns({f"_{e}{i}": F.lit(-1e9) for e in "ab" for i in range(3)}))
    monkeypatch.setattr(pb, "fit_error_model", lambda samples, cfg: taken.append(samples) or samples)
    assert pb.error_model(df, max_tau=20) is taken[0]


def test_queries_make_no_row_per_sample(spark, monkeypatch):
    """The error model of the queries reads the states in order of time, not a join with every later state."""
    from nearpass.plans import q_extra

    def joined(*a, **k):
        raise AssertionError("joined")

    monkeypatch.setattr(pb, "error_samples", joined)
    assert q_extra.q2(spark, "/root/testdata/sf0.001").count() > 0
