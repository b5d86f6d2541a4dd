"""Resampling by count matrices and rate ratios in common steps, against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.operators import bootstrap as bs, eventstats as es, matching as mt


def drawn(seed, rep, n):
    return [int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]


def test_day_counts():
    m = bs.day_counts(7, 3, 9, 11)
    assert m.shape == (6, 11) and (m.sum(axis=1) == 11).all()
    for rep in range(3, 9):
        assert m[rep - 3].tolist() == [drawn(7, rep, 11).count(i) for i in range(11)]


def test_day_bootstrap_of_groups(spark):
    rng = random.Random(1)
    days = {"a": 9, "b": 14, "one": 1}
    rows = [(g, f"d{i:02d}", float(rng.randrange(9)), float(rng.randrange(1, 9))) for g, n in days.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, day string, x double, y double").repartition(3)
    reps = bs.BLOCK + 40  # two blocks
    got = {r["g"]: r for r in bs.day_bootstrap(df, ["x", "y"], {"q": lambda s: s["x"] / s["y"]}, reps=reps, seed=5, group=["g"]).collect()}
    for g, n in days.items():
        mine = [(x, y) for k, _, x, y in rows if k == g]
        assert got[g]["q"] == pytest.approx(sum(x for x, _ in mine) / sum(y for _, y in mine))
        if n < 2:
            assert got[g]["q_lo"] is None
            continue
        values = []
        for rep in range(reps):
            pick = [mine[i] for i in drawn(5, rep, n)]
            values.append(sum(x for x, _ in pick) / sum(y for _, y in pick))
        assert [got[g]["q_lo"], got[g]["q_hi"]] == pytest.approx(np.quantile(values, [0.025, 0.975]).tolist())
    assert bs.day_bootstrap(df.limit(0), ["x"], {"q": lambda s: s["x"]}, reps=4, seed=5).first()["q_lo"] is None


def ratio(rows):
    a, b = sum(r[2] for r in rows), sum(r[3] for r in rows)
    if not rows or a == 0 or b == 0:
        return None
    th = math.log(b * sum(r[4] for r in rows) / (a * sum(r[5] for r in rows)))
    for _ in range(60):
        g = h = 0.0
        for _, _, p, q, e1, e2 in rows:
            k = math.exp(th) * e2 / (e1 + math.exp(th) * e2)
            g, h = g + q - (p + q) * k, h + (p + q) * k * (1 - k)
        th += g / h
    return math.exp(th)


@pytest.mark.parametrize("cells", [2_000_000, 30])
def test_rate_ratios_of_groups(spark, monkeypatch, cells):
    """All groups at once, and in batches."""
    monkeypatch.setattr(es, "CELLS", cells)
    rng = random.Random(2)
    rows = [(g, f"d{rng.randrange(8)}", float(rng.randrange(6)), float(rng.randrange(6)), rng.uniform(0.5, 2), rng.uniform(0.5, 2)) for g in ("a", "b", "c") for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, day string, pre double, post double, e_pre double, e_post double").repartition(4)
    got = {r["g"]: r for r in es.irr(df, reps=25, seed=3, group=["g"], rounds=12).collect()}
    for g in "abc":
        mine = [r for r in rows if r[0] == g and r[2] + r[3] > 0]
        days = sorted({r[1] for r in mine})
        boot = [ratio([r for i in drawn(3, rep, len(days)) for r in mine if r[1] == days[i]]) for rep in range(25)]
        assert got[g]["irr_converged"] and got[g]["irr"] == pytest.approx(ratio(mine), rel=1e-6)
        assert [got[g]["irr_lo"], got[g]["irr_hi"]] == pytest.approx(np.quantile([b for b in boot if b], [0.025, 0.975]).tolist(), rel=1e-5)


def test_rate_ratio_without_counts(spark):
    df = spark.createDataFrame([("a", "d", 0.0, 3.0, 1.0, 1.0), ("b", "d", 2.0, 0.0, 1.0, 1.0), ("c", "d", 0.0, 0.0, 1.0, 1.0)], "g string, day string, pre double, post double, e_pre double, e_post double")
    got = {r["g"]: (r["irr"], r["irr_lo"]) for r in es.irr(df, reps=5, seed=1, group=["g"]).collect()}
    assert got == {"a": (math.inf, None), "b": (0.0, None)}
    assert es.irr(df.limit(0), reps=5, seed=1).first()["irr"] is None


def test_variations_equal_single_comparisons(spark):
    rng = random.Random(9)
    one = lambda i: (f"e{i}", f"d{i % 7}", rng.randrange(3), rng.choice("NS"), False, False, rng.randrange(1, 9), rng.randrange(1, 9), rng.random() < 0.6, rng.choice((1, 2)))
    schema = "event_id string, day string, hour int, flow string, pre_bad boolean, post_bad boolean, pre_T1_any int, post_T1_any int, pre_T1_any_in_control boolean, cluster_size int"
    g, c = (spark.createDataFrame([one(i) for i in range(n)], schema) for n in (40, 90))
    got = {r["variation"]: r for r in mt.robustness(g, c, "T1_any", reps=30, seed=4).collect()}
    ok = F.col("pre_T1_any_in_control")
    for name, gg, cc, keys in (("main", g, c, ("hour",)), ("hour_and_flow", g, c, ("hour", "flow")), ("isolated_only", g.filter("cluster_size = 1"), c, ("hour",)), ("normal_before_only", g.filter(ok), c.filter(ok), ("hour",))):
        want = mt.change_summary(gg, cc, reps=30, seed=4, keys=keys, measures={"T1_any": "T1_any"}).first()
        for col in ("n_events", "n_controls", "ratio", "ratio_lo", "vs_normal", "vs_normal_hi", "n_unmatched", "paired_p"):
            assert got[name][col] == pytest.approx(want[col]), (name, col)
